"""Files in, files out, and streams."""

import json

from pyspark.sql import functions as F

from tariffmill.sinks import export
from tariffmill.sources import readers
from tariffmill.streaming import jobs


def _write(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return path


FILES = {
    "a.pdf": b"%PDF-1.7", "b.bin": b"%PDF-1.4", "c.xlsx": b"PK\x03\x04zip", "d.docx": b"PK\x03\x04zip", "e.zip": b"PK\x03\x04zip", "f.xls": b"\xd0\xcf\x11\xe0x",
    "g.dat": b"\x89PNG\r\n", "h.tiff": b"II*\x00", "i.txt": b"hello", "j.jpg": b"text", "k": b"MM\x00*",
}
KINDS = {"a": "pdf", "b": "pdf", "c": "xlsx", "d": "docx", "e": "unknown", "f": "xls", "g": "image", "h": "image", "i": "unknown", "j": "image", "k": "image"}


def test_landing(spark, tmp_path):
    for name, data in FILES.items():
        _write(tmp_path, name, data)
    landed = readers.landing_inventory(readers.read_files(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[-1].split(".")[0]: r["kind"] for r in landed.collect()}
    assert got == KINDS
    repeats = readers.duplicate_files(readers.file_checksum(landed)).collect()
    assert [r["copies"] for r in repeats] == [3]


def test_incremental_landing_takes_each_content_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name in ("c.xlsx", "d.docx", "a.pdf"):
        _write(inbox, name, FILES[name])
    query = (
        jobs.incremental_landing(spark, str(inbox)).writeStream.format("memory").queryName("landed")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    _write(inbox, "again.pdf", FILES["a.pdf"])
    query.processAllAvailable()
    query.stop()
    assert spark.table("landed").count() == 2


def test_job_status_stream_equals_batch(spark, tmp_path):
    rows = [(f"j{i % 3}", "created" if i < 3 else "done", f"2024-01-01 00:00:{i:02d}") for i in range(6)]
    events = spark.createDataFrame(rows, "job_id string, event string, at string")
    events.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    query = (
        jobs.job_status(stream).writeStream.outputMode("complete").format("memory").queryName("status")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("status").collect())) == sorted(map(tuple, jobs.job_status(events).collect()))
    assert {r["status"] for r in spark.table("status").collect()} == {"done"}


def test_canonical_files(spark, tmp_path):
    contract = {
        "source_filename": "x.xlsx", "is_multi_hotel": False, "detected_rate_type": "Per Person Per Night", "notes": [{"category": "Other", "note": "n"}],
        "hotels": [{"metadata": {"name": "H", "latitude": 1.5}, "rooms": [{"name": "A"}, {"name": "B"}], "seasons": [], "meal_plans": [],
                    "rates": [{"room_name": "A", "dbl": 10.005}], "child_policy": [{"age_from": 2, "age_to": 11.99, "applies_to_rooms": ["A"]}]}],
        "supplements": [{"name": "S", "hotel_name": "H", "supplier_cost": 5}],
    }
    _write(tmp_path, "k1.json", json.dumps(contract, indent=1).encode())
    tables = readers.read_canonical(spark, str(tmp_path))
    assert [(r["contract_id"], r["room"], r["ord"]) for r in tables["rooms"].orderBy("ord").collect()] == [("k1", "A", 0), ("k1", "B", 1)]
    assert [(r["hotel"], float(r["dbl"]), r["room"]) for r in tables["rates"].collect()] == [("H", 10.01, "A")]
    assert tables["child_bands"].collect()[0]["applies_to_rooms"] == ["A"] and tables["seasons"].count() == 0
    assert tables["supplements"].collect()[0]["hotel"] == "H" and tables["hotels"].collect()[0]["latitude"] == 1.5


def test_per_hotel_files_and_header_only_supplements(spark, tmp_path):
    rows = spark.createDataFrame([("c", "1", "A", {"k": 1.0}), ("c", "2", "A", {"k": None}), ("c", "3", "B", {"k": None}), ("d", "4", "A", {"k": None})],
                                 "contract_id string, row_id string, hotel string, child_values map<string,double>")
    per_hotel = export.export_per_hotel(rows)
    assert {(r["row_id"], tuple(r["child_values"])) for r in per_hotel.collect()} == {("1", ("k",)), ("2", ("k",)), ("3", ())}
    export.write_table(per_hotel.drop("child_values"), str(tmp_path / "hotels"), ["contract_id", "hotel_sheet"])
    assert spark.read.parquet(str(tmp_path / "hotels")).where("hotel_sheet = 'A'").count() == 2
    empty = export.export_supplements(rows.where("false"))
    export.write_table(empty, str(tmp_path / "supplements"), fmt="csv")
    assert len(empty.columns) == 35 and empty.count() == 0


def test_supplier_templates_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "templates")
    entries = spark.createDataFrame([("a", "room", "A", 0), ("b", "room", "B", 0)], "supplier_slug string, kind string, value string, first_seen bigint")
    export.write_supplier_templates(entries, path)
    export.write_supplier_templates(entries.where("supplier_slug = 'a'").withColumn("value", F.lit("A2")), path)
    assert sorted((r["supplier_slug"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", "A2"), ("b", "B")]


def test_vision_sections_of_plain_and_broken_text(spark):
    raw = spark.createDataFrame([("1", "no headers"), ("2", '## TEXT\nx\n## TABLES\n```json\n{"rows": [{"a": "1"}]}\n```\n```\n{"rows": [\n```'), ("3", None)], "doc_id string, text string")
    texts, tables = readers.vision_sections(raw)
    assert {r["doc_id"]: r["text"] for r in texts.collect()} == {"1": "no headers", "2": "x", "3": ""}
    assert [(r["doc_id"], r["table_idx"]) for r in tables.collect()] == [("2", 0)]
