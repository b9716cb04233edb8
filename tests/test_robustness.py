"""Large numbers, repeated side rows, sheet references, several contracts in a file, two folders in a session."""

import json

import pytest
from pyspark.sql import functions as F

from tariffmill import session
from tariffmill.adapters.star import StarData
from tariffmill.functions import numbers
from tariffmill.operators import classify, enrich, references, text_rows
from tariffmill.operators.shaping import last_row
from tariffmill.sinks import export
from tariffmill.sources import readers


def test_numbers_too_large_are_no_numbers(spark):
    df = spark.createDataFrame([("3000000000",), ("12",)], "t string")
    assert [r[0] for r in df.select(numbers.to_int("t")).collect()] == [None, 12]


def test_last_row_of_repeated_side_tables(table):
    df = table("k string, v string, ord int", [("a", "x", 1), ("a", "y", 2), ("b", "z", 1)])
    assert {r["k"]: r["v"] for r in last_row(df, ["k"]).collect()} == {"a": "y", "b": "z"}
    plain = df.drop("ord")
    assert {r["k"]: r["v"] for r in last_row(plain, ["k"]).collect()} == {"a": "y", "b": "z"}


def test_repeated_literals_leave_one_row(spark):
    rows = spark.createDataFrame([("c", "b", "R", "5", None)], "contract_id string, batch_id string, room string, extra_bed string, cell_meta string").withColumn(
        "cell_meta", F.create_map().cast("map<string,struct<confidence:double,source_ref:string,ai_inferred:boolean,user_edited:boolean>>"))
    literals = spark.createDataFrame([("c", "b", "R", "10", 1), ("c", "b", "R", "20", 2)], "contract_id string, batch_id string, room string, literal string, ord int")
    assert [float(r["extra_bed"]) for r in enrich.apply_extra_bed_literals(rows, literals).collect()] == [20.0]


def test_sheet_references_are_no_pages(table):
    docs = table("contract_id string, doc_id string, ord int, kind string, page_number int, source_ref string, raw_excerpt string", [
        ("c", "Page:12", 1, "pdf_page", 12, "a.pdf | Page 12", "x"), ("c", "Sheet:Rates", 2, "excel_sheet", None, "b.xlsx | Rates", "y"),
    ])
    refs = table("contract_id string, source_ref string", [("c", "b.xlsx | Rates!Row 12"), ("c", "b.xlsx | 'Rates'!A1:B2"), ("c", "a.pdf | Pages 12")])
    found = {(r["source_ref"], r["doc_id"], r["tier"]) for r in references.resolve_references(refs, docs).collect()}
    assert found == {
        ("b.xlsx | Rates!Row 12", "Sheet:Rates", "sheet"), ("b.xlsx | 'Rates'!A1:B2", "Sheet:Rates", "sheet"), ("a.pdf | Pages 12", "Page:12", "pages"),
    }


def test_contracts_by_file_and_by_line(spark, tmp_path):
    def text(name):
        return json.dumps({"source_filename": name, "hotels": [], "supplements": [], "notes": []})

    for folder, name in (("x", "one"), ("y", "two")):
        (tmp_path / "whole" / folder).mkdir(parents=True)
        (tmp_path / "whole" / folder / "k.json").write_text(text(name))
    (tmp_path / "whole" / "bad.json").write_text('{"hotels": [')
    tables = readers.read_canonical(spark, str(tmp_path / "whole"))
    assert {(r["contract_id"], r["source_filename"]) for r in tables["contracts"].collect()} == {("x/k", "one"), ("y/k", "two")}
    assert [r["contract_id"] for r in tables["broken"].collect()] == ["bad"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "k.json").write_text(text("one") + "\n" + text("two") + "\n{\n")
    tables = readers.read_canonical(spark, str(tmp_path / "lines"), lines=True)
    found = tables["contracts"].collect()
    assert {r["source_filename"] for r in found} == {"one", "two"} and len({r["contract_id"] for r in found}) == 2
    assert tables["broken"].count() == 1


def test_two_folders_in_one_session(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 5)):
        spark.range(n).select(F.col("id").alias("r_regionkey"), F.col("id").cast("string").alias("r_name")).write.parquet(str(tmp_path / folder / "region.parquet"))
    import tariffmill.adapters.star as star
    first, second = star.StarData(spark, str(tmp_path / "a")), star.StarData(spark, str(tmp_path / "b"))
    original = star.sql_with_views
    star.sql_with_views = lambda query, dialect: "SELECT * FROM region"
    try:
        assert (first.view("region").count(), second.view("region").count(), first.view("region").count()) == (3, 5, 3)
    finally:
        star.sql_with_views = original
    assert StarData is star.StarData


def test_exports_leave_no_partition_of_an_earlier_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, hotel string")
    export.write_table(df, str(tmp_path / "out"), ["hotel"])
    export.write_table(df.where("hotel = 'a'"), str(tmp_path / "out"), ["hotel"])
    assert [r["hotel"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_reference_limits_remain_as_arguments(spark):
    docs = spark.createDataFrame([("c", "d", " ".join(f"01.0{k}.2024 - 09.0{k}.2024" for k in range(1, 6)))], "contract_id string, doc_id string, raw_excerpt string")
    assert text_rows.rate_periods(docs).count() == 5 and text_rows.rate_periods(docs, limit=3).count() == 3
    many = spark.range(50).select(F.lit("c").alias("contract_id"), F.lit("hotel_contract").alias("classification"), F.col("id").alias("ord"))
    assert classify.priority_documents(many).count() == 50
    assert classify.priority_documents(many, classify.REQUEST_DOCUMENTS).count() == 40


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_lost_references_reach_the_whole_contract(table):
    docs = table("contract_id string, doc_id string, ord int, kind string, page_number int, source_ref string, raw_excerpt string", [
        ("c", f"d{i}", i, "other", None, None, str(i) * 5000) for i in range(4)
    ])
    refs = table("contract_id string, source_ref string", [("c", "nowhere")])
    def found(*limit):
        return sorted((r["doc_id"], r["tier"]) for r in references.resolve_references(refs, docs, *limit).collect())
    assert found() == [(f"d{i}", "approximate") for i in range(4)]
    assert found(references.SHOWN_CHARACTERS) == [("d0", "approximate"), ("d1", "approximate")]
    assert {r["doc_id"]: r["_block"] for r in references.opening_documents(docs).collect()} == {f"d{i}": f"[d{i}]\n" + str(i) * 5000 for i in range(4)}
