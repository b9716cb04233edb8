"""Operators whose limit is the point, merged contracts as content, and differences that start from fingerprints."""

import pytest
from pyspark.sql import functions as F

from tariffmill.operators import audit, classify, grid, merge, text_rows

ROWS = "contract_id string, hotel string, room string, ord int"


def test_samples_and_their_note(spark):
    cells = spark.createDataFrame([("c", "d", "Double", 0, i, f"{i},50") for i in range(11)] + [("c", "d", "Single", 0, 0, "7")],
                                  "contract_id string, doc_id string, col_name string, table_idx int, row_idx int, raw string")
    assert cells.count() == 12 and sorted(r.row_idx for r in audit.sample_cells(cells, 8).where("col_name = 'Double'").collect()) == list(range(8))
    notes = {r.note.split("'")[1]: r.note for r in audit.unmapped_notes(cells, 8).collect()}
    assert "contained 11 numeric value(s) that no Hotel row used: '0,50', '1,50'" in notes["Double"] and "'7,50' (+3 more). Cross" in notes["Double"]
    assert "contained 1 numeric value(s) that no Hotel row used: '7'. Cross" in notes["Single"]


def test_retry_text_counts_what_it_leaves_out(spark):
    missing = spark.createDataFrame([("c", h, "R", f"S{i:03d}", "BB", 0, i, 0) for h, n in (("big", 64), ("small", 60)) for i in range(n)],
                                    "contract_id string, hotel string, room string, season string, meal string, room_ord int, season_ord int, meal_ord int")
    told = {r.hotel: r for r in grid.retry_directives(missing, 60).collect()}
    assert told["big"].missing == 64 and told["big"].text.startswith("('R', 'S000', 'BB'); ('R', 'S001', 'BB')")
    assert told["big"].text.endswith("('R', 'S059', 'BB'). Plus 4 more (room, season, meal_code) combinations following the same pattern.")
    assert told["small"].text.endswith("('R', 'S059', 'BB').") and grid.retry_triples(missing).count() == 124


def test_first_periods_and_first_documents(spark):
    docs = spark.createDataFrame([("c", f"d{i}", "01.01.2024 02.01.2024 " * (i + 1), "support_notes" if i < 3 else "hotel_contract", i, "pdf") for i in range(6)],
                                 "contract_id string, doc_id string, raw_excerpt string, classification string, ord int, input_format string")
    assert text_rows.rate_periods(docs).count() == 21
    assert {r.doc_id: r["count"] for r in text_rows.rate_periods(docs, limit=3).groupBy("doc_id").count().collect()} == {f"d{i}": min(i + 1, 3) for i in range(6)}
    assert sorted(r.doc_id for r in classify.priority_documents(docs, 4).collect()) == ["d0", "d3", "d4", "d5"]


@pytest.mark.parametrize("kind, characters, rows, columns", [("pdf", 10_000, 120, 40), ("XLSX", 60_000, 1000, 100), (None, 8_000, 200, 40)])
def test_request_documents_are_cut_by_format(spark, kind, characters, rows, columns):
    docs = spark.createDataFrame([("c", f"d{i}", "x" * 70_000, "hotel_contract", i, kind) for i in range(41)],
                                 "contract_id string, doc_id string, raw_excerpt string, classification string, ord int, input_format string")
    cells = spark.createDataFrame([("c", "d0", r, c, "v") for r in (0, 119, 120, 199, 200, 999, 1000) for c in (0, 39, 40, 99, 100)] + [("c", "d40", 0, 0, "v")],
                                  "contract_id string, doc_id string, row_idx int, col_idx int, value_str string")
    kept, inside = classify.trim_for_budget(docs, cells, classify.REQUEST_DOCUMENTS, classify.FORMAT_CAPS)
    texts = {r.doc_id: r.raw_excerpt for r in kept.collect()}
    assert set(texts) == {f"d{i}" for i in range(40)} and set(texts.values()) == {"x" * characters + "\n...[truncated]"}
    assert {(r.row_idx, r.col_idx) for r in inside.collect()} == {
        (r, c) for r in (0, 119, 120, 199, 200, 999, 1000) for c in (0, 39, 40, 99, 100) if r < rows and c < columns}


def test_merged_contract_holds_the_tables_of_all_chunks(spark):
    notes = spark.createDataFrame([("c", "n1", "f", "p", "Other", "Gala ", 0), ("c", "n2", "f", "p", "Other", " gala", 1), ("c", "n3", None, "p", "Other", "gala", 2)],
                                  "contract_id string, note_id string, source_file string, page string, category string, note string, ord int")
    columns = spark.createDataFrame([("c", "K", "first", None, "amount", 1), ("c", "K", "again", "x", "amount", 2), ("c", None, "L", None, None, 3), ("c", "", "", None, None, 0)],
                                    "contract_id string, key string, label string, position string, value_type string, ord int")
    hotels = spark.createDataFrame([("c", "H", 0, 0, None, "1"), ("c", "H", 1, 0, "Athens", "2"), ("c", None, 1, 1, "", "3")],
                                   "contract_id string, hotel string, part_idx int, ord int, city_area string, phone string")
    parts = spark.createDataFrame([("c", 0, None, "pdf", 0.5), ("c", 1, "a.pdf", "docx", 0.8)], "contract_id string, part_idx int, source_file string, input_format string, confidence double")
    rows = spark.createDataFrame([("c", "r1", "H", "A", "s", "e", "BB", 0), ("c", "r1", "H", "A", "s", "e", "BB", 1)],
                                 "contract_id string, row_id string, hotel string, room string, start_date string, end_date string, meal_plan string, ord int")
    issues = spark.createDataFrame([("c", "r1", "H", "error", "m", None)], "contract_id string, row_id string, hotel string, severity string, message string, field string")
    frame = merge.merged_contract(rows, notes, columns, issues, parts, hotels)

    def table(part, *fields):
        return {(r.key, *[r[f] for f in fields]) for r in merge.take_apart(frame, part, list(fields)).collect()}

    assert table("notes", "note_id", "note") == {("f|p|Other|gala", "n1", "Gala "), ("|p|Other|gala", "n3", "gala")}
    assert table("child_columns", "label", "position") == {("K", "first", None), ("L", "L", None)}
    assert table("hotels", "city_area", "phone") == {("H", "Athens", "1"), ("Unknown Hotel", None, "3")}
    assert table("summary", "source_file", "input_format", "overall_confidence") == {("", "a.pdf", "pdf", "0.650")}
    assert frame.where("part = 'rows' AND field = 'room'").count() == 2 and frame.where("part = 'issues'").count() == 4


def test_golden_diff_of_whole_multisets(spark):
    def rows(*values):
        return spark.createDataFrame([(c, "H", r, i) for i, (c, r) in enumerate(values)], ROWS)

    left = rows(("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), (None, "x"), (None, "y"), ("only", "1"))
    right = rows(("a", "2"), ("a", "1"), ("a", "1"), ("b", "1"), ("b", "1"), (None, "y"), (None, "z"), ("new", "1"))
    got = {(r.contract_id, r.room): r.surplus for r in merge.golden_diff(left, right).collect()}
    assert got == {("b", "1"): -1, (None, "x"): 1, (None, "z"): -1, ("only", "1"): 1, ("new", "1"): -1}
    assert merge.golden_diff(left, left).count() == 0


def test_failed_chunks_in_long_form(spark):
    chunks = spark.createDataFrame([("c", 3, ["x", "y"]), ("c", 4, []), ("d", 1, ["z"])], "contract_id string, chunk_idx int, errors array<string>")
    assert {tuple(r) for r in merge.failed_chunks(chunks).collect()} == {("c", 3, 0, "x"), ("c", 3, 1, "y"), ("d", 1, 0, "z")}
    assert chunks.where(F.size("errors") > 0).count() == merge.chunk_failure_notes(chunks).count()
