"""Cells, texts and child values are read where they are few, and not again by a later step."""

from pyspark.sql import functions as F

from tariffmill.adapters.star import StarData
from tariffmill.functions.dates import days_mask, normalize_iso_date
from tariffmill.operators import audit, classify, dedup, grid, normalize, text_rows
from tariffmill.plans.catalog import queries

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_child_values_are_read_once_a_row(spark):
    star = StarData(spark, FOLDER)
    rows = normalize.normalize_rows(star.raw_rows, star.child_columns, star.options)[0]
    assert _plan(rows).count("map_from_entries(") == 1


def test_texts_and_numbers_give_the_same_percentage_columns(spark):
    columns = spark.createDataFrame(
        [("c", "A", "unknown"), ("c", "B", "amount"), ("c", "C", "discount_percentage"), ("c", "D", None), ("d", "A", "amount"), ("e", "A", None)],
        "contract_id string, key string, value_type string",
    )
    rows = spark.createDataFrame([
        ("c", {"A": " 0.5 ", "B": "30", "C": "free", "D": "free", "X": "0.1"}), ("c", {"A": "free", "B": "0.5", "C": "0.2", "D": "ask"}),
        ("d", {"A": "n/a"}), (None, {"A": "0.5"}), ("e", None), ("e", {"A": "1"}),
    ], "contract_id string, child_values map<string,string>")
    found = normalize.detect_percentage_texts(rows, columns).collect()
    assert sorted((r.contract_id, r.key, r.value_type or "") for r in found) == [
        ("c", "A", "percentage_of_adult"), ("c", "B", "amount"), ("c", "C", "discount_percentage"), ("c", "D", "percentage_of_adult"),
        ("d", "A", "amount"), ("e", "A", "percentage_of_adult"),
    ]


def test_day_masks_and_dates_keep_their_rules(spark):
    days = [("3-9", "3456789"), ("6 to 0", "1234567"), ("0", "7"), ("7", "7"), ("7 and 8", "1234567"), ("2,2,0", "27"), (" 5 ", "5"), ("", "1234567")]
    got = spark.createDataFrame(days, "d string, want string").select("want", days_mask("d").alias("m")).collect()
    assert [r.m for r in got] == [r.want for r in got]
    dates = [("2025-01-021", "2025-01-02"), ("2025-1-2", "2025-01-02"), (" 2025-12-3 x", "2025-12-03"), ("2025-12-31 00:00", "2025-12-31"), ("soon", None)]
    got = spark.createDataFrame(dates, "d string, want string").select("want", normalize_iso_date("d").alias("m")).collect()
    assert [r.m for r in got] == [r.want for r in got]


def test_table_facts_are_told_without_a_list_a_cell(spark):
    cells = spark.createDataFrame([
        ("c", "d", 0, "Double room", "1/5/2025 -  3/5/2025"), ("c", "d", 0, "Double room", " 1/5/2025 - 3/5/2025 "), ("c", "d", 0, "1.1.25", "bb"),
        ("c", "d", 0, "HB", None), ("c", "e", 0, None, "120"),
    ], "contract_id string, doc_id string, table_idx int, col_name string, raw string")
    sized = audit.rate_dimensions(cells)
    assert sorted((r.doc_id, r.rooms, r.periods, r.boards) for r in sized.collect()) == [("d", 1, 2, 2), ("e", 0, 0, 0)]
    assert "lambda" not in _plan(sized)


def test_notes_of_a_text_take_one_scan(spark):
    docs = spark.createDataFrame([
        ("c", "Page:1", "pdf_page", "hotel_contract", None, "r", "A ſervice charge, İnfant, no-show from 1/5/2025 to 31/10/2025 GALA"),
        ("c", "Page:2", "pdf_page", None, None, "r", "galaxy nocancellation 1/5/2025"), ("c", "Page:3", "pdf_page", "index_reference", None, "r", "tax"),
        ("c", "Page:4", "pdf_page", "unknown", None, "r", None),
    ], "contract_id string, doc_id string, kind string, classification string, detected_hotel_name string, source_ref string, raw_excerpt string")
    notes = text_rows.text_notes(docs)
    plain = {c: p[p.index("(?iU)"):] for c, p in text_rows.NOTE_TRIGGERS.items()}
    want = {(r.doc_id, c) for c, p in plain.items() for r in docs.where("classification IS NULL OR classification <> 'index_reference'").where(
        F.coalesce("raw_excerpt", F.lit("")).rlike(p)).collect()} | {("Page:2", "Source ambiguity"), ("Page:4", "Source ambiguity")}
    assert {(r.doc_id, r.category) for r in notes.collect()} == want and ("Page:1", "Taxes/service") in want
    assert _plan(notes).count("LogicalRDD") + _plan(notes).count("LocalRelation") == 1


def test_cells_without_a_word_meet_no_word_pattern(spark):
    cells = spark.createDataFrame([
        ("c", "Sheet:a", 0, 0, " Grand HOTEL "), ("c", "Sheet:b", 0, 0, "12.50"), ("c", "Sheet:b", 0, 1, "ſpa"), ("c", "Sheet:c", 0, 0, "inn" + "x" * 80),
        ("c", "Sheet:c", 1, 0, "in n"),
    ], "contract_id string, doc_id string, row_idx int, col_idx int, value_str string")
    sheets = classify.classify_sheets(cells)
    assert {r.doc_id: r.detected_hotel_name for r in sheets.collect()} == {"Sheet:a": "Grand HOTEL", "Sheet:b": "ſpa", "Sheet:c": None}
    assert "[^\\x00-@]{3}" in _plan(sheets)


def test_seasons_are_written_once_for_their_index(spark):
    seasons = spark.createDataFrame([
        ("c", "h", "High", "2025-01-01", "2025-03-31", 0), ("c", "h", "High & low", "2025-01-01", "2025-12-31", 1), ("c", "k", "High", "2025-01-01", "2025-03-31", 2),
    ], "contract_id string, hotel string, label string, start_date string, end_date string, ord int")
    left = dedup.drop_contained_seasons(seasons)
    assert sorted(r.ord for r in left.collect()) == [1, 2]
    assert "LogicalRDD" not in _plan(left) and "LocalRelation" not in _plan(left)


def test_gaps_are_filled_without_the_grid(spark):
    cell = "contract_id string, hotel string, room string, season string, meal string, ord int, sgl double, dbl double, tpl double, qdp double"
    def prices(rows):
        return spark.createDataFrame([("c", h, r, s, m, o, None, d, None, None) for o, (h, r, s, m, d) in enumerate(rows)], cell)
    def axis(name, rows):
        return spark.createDataFrame([("c", *r, i) for i, r in enumerate(rows)], f"contract_id string, hotel string, {name} string, ord int")
    rates = prices([("h", "A", "S", "BB", 1.0), ("h", "B", "S", "BB", None), (None, "A", "S", "BB", None)])
    patch = prices([
        ("h", "A", "S", "BB", 5.0), ("h", "B", "S", "BB", 6.0), ("h", "B", "S", "BB", 7.0), ("h", "C", "S", "BB", 8.0), ("h", "A", "T", "BB", None),
        ("h", "A", "T", "BB", 9.0), ("h", "", "S", "BB", 1.0), ("h", "A", None, "BB", 1.0), (None, "A", "S", "BB", 1.0), ("k", "A", "S", "BB", 1.0),
    ])
    axes = (axis("room", [("h", "A"), ("h", "B"), ("h", "B"), ("h", ""), (None, "A"), ("k", "A")]),
            axis("label", [("h", "S"), ("h", "T"), ("h", None), ("k", "S")]), axis("code", [("h", "BB"), (None, "BB")]))
    def rows(df):
        return sorted(map(str, df.select(*grid.CELL, "dbl", "ord").collect()))
    filled = rows(grid.fill_grid_gaps(rates, patch, *axes))
    assert filled == rows(grid.fill_missing_rates(rates, patch, grid.missing_rates(*axes, rates))) and len(filled) == 5
    assert "_slice" not in _plan(queries()["j3_fill_missing_rates"](spark, FOLDER))
