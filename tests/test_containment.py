"""Joins on containment, scans in stretches and assembled texts against brute force."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tariffmill.operators import blocks, classify, dedup, references
from tariffmill.operators.containment import contained_pairs, numbers_in_ranges, strictly_inside
from tariffmill.operators.shaping import carry_forward, text_chunks


def test_contained_pairs(spark):
    rng = random.Random(1)
    def made(n):
        return [(rng.choice(["g", "g", "h"]), "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))) for _ in range(120)]
    needles, texts = made(5) + [("g", ""), ("x", "a")], made(9) + [("g", "")]
    got = contained_pairs(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "k string, text string"), ["k"])
    want = {(k, n, t) for k, n in needles for q, t in texts if k == q and n and n in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_numbers_in_ranges(spark):
    rng = random.Random(2)
    ranges = [("g", i, *sorted((rng.choice([0, 1, 5, 64, 1000, 2**30]), rng.randint(0, 1100)))) for i in range(60)] + [("g", 99, 9, 3), ("h", 100, 0, 5), ("g", 101, -7, 2)]
    numbers = [("g", rng.randint(0, 1100)) for _ in range(80)] + [("g", 2**30), ("g", 0), ("g", -5), ("h", 5), ("i", 1)]
    got = numbers_in_ranges(spark.createDataFrame(ranges, "k string, i int, low int, high int"), spark.createDataFrame(numbers, "k string, n int").distinct(), ["k"], "low", "high", "n")
    want = {(i, n) for k, i, a, b in ranges for q, n in set(numbers) if k == q and a <= n <= b and n >= 0}
    assert sorted((r.i, r.n) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [1, 3, 100])
def test_strictly_inside(spark, width):
    rng = random.Random(3)
    spans = [(rng.choice("gh"), *sorted((rng.randint(0, 20), rng.randint(0, 20)))) for _ in range(80)]
    got = strictly_inside(spark.createDataFrame(spans, "k string, a int, b int"), ["k"], "a", "b", F.floor(F.col("a") / width))
    want = {(k, a, b) for k, a, b in spans for q, c, d in spans if k == q and c <= a and b <= d and (a, b) != (c, d)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_carry_forward(spark, width):
    rng = random.Random(4)
    rows = [(k, i, rng.random() < 0.2) for k in "gh" for i in sorted(rng.sample(range(90), 40))] + [("none", i, False) for i in (0, 50)]
    df = spark.createDataFrame(rows, "k string, i int, opens boolean")
    got = carry_forward(df, ["k"], "i", F.when(F.col("opens"), F.struct("i")), "m", width)
    want = []
    for k, i, _ in rows:
        marks = [j for q, j, o in rows if q == k and o]
        so_far = [j for j in marks if j <= i]
        want.append((k, i, so_far[-1] if so_far else None, len(so_far), marks[0] if marks else None, len(marks)))
    assert sorted(map(str, want)) == sorted(str((r.k, r.i, r.m and r.m.i, r.m_no, r.m_first and r.m_first.i, r.m_count)) for r in got.collect())


@pytest.mark.parametrize("characters", [1, 7, 50, 10_000])
def test_chunks_make_up_the_text(spark, characters):
    rng = random.Random(5)
    lines = [(k, i, "x" * rng.choice([0, 1, 5, 30]) + str(i)) for k in "gh" for i in range(40)]
    chunks = text_chunks(spark.createDataFrame(lines, "k string, i int, text string"), ["k"], "i", characters).collect()
    for k in "gh":
        own = sorted((c.chunk, c.text) for c in chunks if c.k == k)
        assert "".join(t for _, t in own) == "".join(t for q, _, t in lines if q == k)
        assert len(own) == len({n for n, _ in own}) and all(len(t) < characters + 33 for _, t in own)


def test_a_long_sheet_is_placed_by_stretches(spark, monkeypatch):
    """Blocks, expansion and texts are the same however short the stretches are; no window holds a sheet alone."""
    from tariffmill.operators import shaping
    rows = [("c", "s", i, 0, f"Contract Rate {i}" if i % 37 == 5 else f"row {i}", None, "string") for i in range(300)]
    cells = spark.createDataFrame(rows, blocks_schema := "contract_id string, doc_id string, row_idx int, col_idx int, value_str string, value_num double, value_type string")
    plain = sorted(map(str, blocks.rate_blocks(cells).collect()))
    short = shaping.carry_forward
    monkeypatch.setattr(blocks, "carry_forward", lambda *a: short(*a, width=16))
    assert sorted(map(str, blocks.rate_blocks(cells).collect())) == plain and len(plain) == 295 + 5 * 8
    openings = [i for i in range(300) if i % 37 == 5]
    got = {(r.row_idx, r.block_idx) for r in blocks.rate_blocks(cells).where("NOT is_preamble").collect()}
    assert got == {(i, max(b for b, o in enumerate(openings) if o <= i)) for i in range(5, 300)}
    parts = blocks.sheet_text(cells, 100).orderBy("chunk").collect()
    assert len(parts) > 20 and "".join(p.text for p in parts).split("\n")[2:] == [f"{i + 1}\t{r[4]}" for i, r in enumerate(rows)]
    assert blocks_schema


@pytest.mark.parametrize("width", [1, 8, 1024])
def test_cells_meet_overlapping_blocks(spark, width):
    rng = random.Random(6)
    cells = [("c", "s", i, j, str(100 * i + j), None, "number") for i in range(60) for j in range(3)]
    ranges = [("c", "s", b, "t", *sorted((rng.randint(0, 70), rng.choice([rng.randint(0, 70), 2_000_000_000])))) for b in range(6)]
    columns = [("c", "s", b, j, role, None, None, None, None, None, None, j) for b in range(6) for j, role in ((1, "base_room"), (2, "sgl_supp"))]
    schema = "contract_id string, doc_id string, row_idx int, col_idx int, value_str string, value_num double, value_type string"
    got = blocks.grid_rows(
        spark.createDataFrame(cells, schema),
        spark.createDataFrame(ranges, "contract_id string, doc_id string, block_idx int, title string, first_data_row_idx int, last_data_row_idx int"),
        spark.createDataFrame(columns, "contract_id string, doc_id string, block_idx int, col_idx int, role string, label string, position string, "
                              "age_from decimal(5,2), age_to decimal(5,2), value_type string, supp_field string, ord int"),
        spark.createDataFrame([], "contract_id string, doc_id string, position string, age_from decimal(5,2), age_to decimal(5,2), ord int"), width,
    )
    want = {(b, i, 100 * i + 1, 100 * i + 2) for _, _, b, _, low, high in ranges for i in range(60) if low <= i <= high}
    assert {(r.block_idx, r.row_idx, int(r.base), int(r.sgl_supp)) for r in got.collect()} == want


def test_best_room_equals_all_pairs(spark):
    """Every name with every entry by the score alone, against the indexes and their bounds."""
    from tariffmill.functions.names import room_match_score
    rng = random.Random(7)
    words = ["deluxe", "dlx", "sea", "view", "pool", "room", "sup", "superior", "family", "pv", "garden", "the", "a", "x1", "x2", "x3"]
    def name():
        made = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        return rng.choice([made, made.upper(), f"  {made} ", made[:rng.randint(1, len(made))]])
    rooms = [("c", rng.choice("st"), name()) for _ in range(150)] + [("c", "s", ""), ("c", "s", None), ("c", "s", " ")]
    entries = [("c", rng.choice("st"), name(), i, i, i, i, i) for i in range(60)] + [("c", "s", " ", 1, 1, 1, 1, 60), ("c", "s", None, 1, 1, 1, 1, 61)]
    asked = spark.createDataFrame(rooms, "contract_id string, doc_id string, room string")
    listed = spark.createDataFrame(entries, "contract_id string, doc_id string, room_name string, min_adult int, max_adult int, max_pax int, max_child int, ord int")
    got = {(r.doc_id, r.room): r._entry.ord for r in blocks.match_rooms(asked, listed).collect()}
    all_pairs = asked.distinct().join(listed, ["contract_id", "doc_id"]).withColumn("score", room_match_score("room", "room_name")).where("score > 0")
    want = {(r.doc_id, r.room): -r.best[1] for r in all_pairs.groupBy("doc_id", "room").agg(F.max(F.struct("score", -F.col("ord"))).alias("best")).collect()}
    assert got == want and len(want) > 100


def test_seasons_inside_others_equal_all_pairs(spark):
    rng = random.Random(8)
    seasons = []
    for i in range(150):
        a, b = sorted((rng.randint(1, 28), rng.randint(1, 28)))
        month = rng.choice([1, 1, 2])
        seasons.append(("c", rng.choice("hk"), rng.choice(["high", "High  season", "low", "w", "", None, "high season w"]),
                        rng.choice([f"2024-{month:02d}-{a:02d}", f"2024-{month:02d}-{a:02d}T00", "2024", None]), f"2024-{month + rng.randint(0, 1):02d}-{b:02d}", i))
    df = spark.createDataFrame(seasons, "contract_id string, hotel string, label string, start_date string, end_date string, ord int")
    def label(x):
        return " ".join((x or "").lower().split())
    def dated(x):
        return x[3] is not None and len(x[3]) >= 10 and len(x[4]) >= 10
    def inside(s, w):
        return (dated(s) and dated(w) and s[1] == w[1] and w[3][:10] <= s[3][:10] and s[4][:10] <= w[4][:10]
                and (w[3][:10] < s[3][:10] or s[4][:10] < w[4][:10]) and label(s[2]) and label(s[2]) in label(w[2]))
    want = [s[5] for s in seasons if not any(inside(s, w) for w in seasons)]
    assert sorted(r.ord for r in dedup.drop_contained_seasons(df).collect()) == want and 10 < len(want) < 145


def test_narrowest_override_equals_all_pairs(table):
    rng = random.Random(9)
    bands = [("c", "s", i, "child", rng.choice(["first", "second"]), *sorted((rng.randint(0, 12), rng.randint(0, 17)))) for i in range(60)]
    overrides = [("c", "s", rng.choice(["first", "second"]), *sorted((rng.randint(0, 12), rng.randint(0, 17))), i) for i in range(40)]
    got = blocks.narrow_child_ages(
        table("contract_id string, doc_id string, ord int, role string, position string, age_from decimal(5,2), age_to decimal(5,2)", bands),
        table("contract_id string, doc_id string, position string, age_from decimal(5,2), age_to decimal(5,2), ord int", overrides))
    want = {}
    for _, _, i, _, p, a, b in bands:
        inner = [(t - f, o, f, t) for _, _, q, f, t, o in overrides if q == p and a <= f and t <= b and t - f < b - a]
        want[i] = min(inner)[2:] if inner else (a, b)
    assert {r.ord: (int(r.age_from), int(r.age_to)) for r in got.collect()} == want


def test_sheets_by_letters_equal_all_pairs(spark):
    rng = random.Random(10)
    def word():
        return "".join(rng.choice("ab1") for _ in range(rng.randint(0, 6)))
    hotels = [(rng.choice("cd"), f"{word()} {word()}!", None, i) for i in range(80)]
    sheets = [(rng.choice("cd"), f"{word()}-{word()}", i) for i in range(40)] + [("d", "--", 99)]
    got = references.match_sheets(spark.createDataFrame(hotels, "contract_id string, hotel string, source_hint string, ord int"),
                                  spark.createDataFrame(sheets, "contract_id string, name string, ord int"))
    def letters(x):
        return "".join(c for c in x.lower() if c.isalnum())
    want = {}
    for k, h, _, i in hotels:
        fit = [(o, n) for q, n, o in sheets if q == k and letters(h) and (letters(h) in letters(n) or letters(n) in letters(h))]
        want[i] = next((n for q, n, o in sheets if q == k and n.strip() == h.strip()), min(fit)[1] if fit else None)
    assert {r.ord: r.sheet for r in got.collect()} == want


def test_lost_references_are_one_row_each(spark):
    docs = spark.createDataFrame([("c", f"d{i}", i, "pdf_page", i, f"f | {i}", "t" * 10) for i in range(50)],
                                 "contract_id string, doc_id string, ord int, kind string, page_number int, source_ref string, raw_excerpt string")
    refs = spark.createDataFrame([("c", f"nowhere {i}") for i in range(20)] + [("c", "x | Pages 400-900"), ("c", "x | Pages -3 and 60"), ("c", "f | 7")], "contract_id string, source_ref string")
    links = references.reference_links(refs, docs)
    tiers = {r.tier: r.n for r in links.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert tiers == {"approximate": 21, "exact": 1, "pages": 1}
    assert references.lost_documents(links, docs).count() == 50
    assert references.resolve_references(refs, docs).where("tier = 'approximate'").count() == 21 * 50
    text = "".join(r.text for r in references.opening_text(docs, characters=40).orderBy("chunk").collect())
    assert text == "".join(f"[d{i}]\n{'t' * 10}\n\n" for i in range(50))
    assert "".join(r.text for r in references.opening_text(docs, 123, 40).orderBy("chunk").collect()) == text[:123]


def test_a_text_of_many_stretches_and_columns(spark, monkeypatch):
    """Offsets by arithmetic (numbers, tabs, letters of one to three characters) cut the text where its characters are counted."""
    monkeypatch.setattr(blocks, "ROWS_PER_DEAL", 7)
    rng = random.Random(3)
    cells = [("c", doc, i, j, f"v{i}", None, "string") for doc, width in (("Sheet:a", 5), ("b", 60), ("Sheet:w", 720))
             for i in range(0, 130, 3) for j in {rng.randrange(width), width - 1 if i == 60 else 0}]
    schema = "contract_id string, doc_id string, row_idx int, col_idx int, value_str string, value_num double, value_type string"
    frame = spark.createDataFrame(cells, schema)
    got = blocks.sheet_text(frame, 50).collect()
    for doc, width in (("Sheet:a", 5), ("b", 60), ("Sheet:w", 720)):
        lines = {r.line: r.text for r in blocks.grid_lines(frame.where(F.col("doc_id") == doc)).collect()}
        letters = [r.l for r in spark.range(width).orderBy("id").select(blocks.column_letter(F.col("id")).alias("l")).collect()]
        head = f"=== Sheet: {doc.removeprefix('Sheet:')} ===\nRow\t" + "\t".join(letters)
        want, at = {}, 0
        for piece in [head] + ["\n" + lines[n] for n in sorted(lines)]:
            want[at // 50] = want.get(at // 50, "") + piece
            at += len(piece)
        assert {r.chunk: r.text for r in got if r.doc_id == doc} == want


def test_rooms_of_small_sheets_are_matched_without_an_index(spark, monkeypatch):
    """Sheet by sheet and by the index the same entries are found; without crowded sheets no gram is made."""
    names = ["Sup PV", "standard", " Standard ", "pool", "Suite", "", None, "x"]
    asked = spark.createDataFrame([("c", f"d{k}", n) for k in range(3) for n in names] * 2, "contract_id string, doc_id string, room string")
    entries = [("SUPERIOR Pool View", 0), ("Sup PV", 1), ("standard", 2), ("Standard", 3), ("  ", 4), ("Junior suite", 5)]
    listed = spark.createDataFrame([("c", f"d{k}", n, o, 1, 2, 3, 1) for k in range(2) for n, o in entries],
                                   "contract_id string, doc_id string, room_name string, ord int, min_adult int, max_adult int, max_pax int, max_child int")
    few = blocks.match_rooms(asked, listed)
    assert "explode" not in few._jdf.queryExecution().optimizedPlan().toString().lower()
    want = sorted(map(str, few.collect()))
    assert len(want) == 10
    for most in (0, 6, 15):
        monkeypatch.setattr(blocks, "FACTS_PER_SHEET", most)
        assert sorted(map(str, blocks.match_rooms(asked, listed).collect())) == want


def grid_tables(spark):
    def table(schema, rows):
        return spark.createDataFrame(rows, f"contract_id string, doc_id string, {schema}")

    docs = [("c", "d0"), ("c", "d1"), ("e", "d0")]
    texts = ["2025-01-01", "2025-12-31", "100", "12", "7", "50%", "20", "14"]
    cells = [(*d, r, k, t) for i, d in enumerate(docs) for r in (3, 5, 3000) for k, t in enumerate(texts) if (i, r, k) != (1, 5, 2)]
    roles = ["date_from", "date_to", "base_room", "sgl_supp", "tpl_reduct", "child", "upgrade", "release"]
    columns = [(*d, b, role, k, {"base_room": "Standard", "upgrade": "Sup PV"}.get(role), "first_child" if role == "child" else None,
                0 if role == "child" else None, 12 if role == "child" else None, None, None, k)
               for d in docs for b in (0, 1) for k, role in enumerate(roles)]
    return {
        "cells": table("row_idx int, col_idx int, value_str string", cells),
        "blocks": table("block_idx int, title string, first_data_row_idx int, last_data_row_idx int",
                        [(*d, b, "T" if b else None, 4 * (1 - b), 4000) for d in docs for b in (0, 1)]),
        "block_columns": table("block_idx int, role string, col_idx int, label string, position string, age_from decimal(5,2), age_to decimal(5,2), "
                               "value_type string, supp_field string, ord int", [tuple(Decimal(x) if i in (7, 8) and x is not None else x for i, x in enumerate(c)) for c in columns]),
        "overrides": table("position string, age_from decimal(5,2), age_to decimal(5,2), ord int", [
            (*d, "first_child", Decimal(a), Decimal(b), o) for d in docs[:2] for a, b, o in ((0, 6, 0), (2, 6, 1), (3, 7, 2), (3, 7, 0), (0, 12, 3))]),
        "occupancy": table("room_name string, ord int, min_adult int, max_adult int, max_pax int, max_child int", [
            (*d, n, o, 1, 2, 3, o) for d in docs for n, o in (("Superior pool view", 0), ("standard", 1))]),
        "meta": table("name string, supplier string, country_code string, state_or_region string, city_or_area string, currency string, "
                      "rate_type string, stars string, basic_treatment string", [(*docs[0], "Grand", "S", "GR", "A", None, "", "R", "4", "HB")]),
        "options": spark.createDataFrame([("c", "D", "ES", "Athens", "USD", None, "14:00", "11:00")],
                                         "contract_id string, supplier string, country string, city_area string, currency string, status string, check_in string, check_out string"),
    }


@pytest.mark.parametrize("few, most", [(0, 0), (16, 24), (15, 20_000)])
def test_small_sheets_are_expanded_where_they_are_dealt(spark, monkeypatch, few, most):
    """Sheets worked on as a whole and crowded ones give the same rows; of the former no role is repeated for a stretch of rows."""
    t = grid_tables(spark)
    grid = blocks.grid_rows(t["cells"], t["blocks"], t["block_columns"], t["overrides"])
    assert "stretch" not in grid._jdf.queryExecution().optimizedPlan().toString()
    rows = blocks.expand_blocks(*t.values())
    want = sorted(map(str, grid.collect())), sorted(map(str, rows.collect()))
    assert len(want[0]) == 15 and len(want[1]) == 26
    monkeypatch.setattr(blocks, "FACTS_PER_SHEET", few)
    monkeypatch.setattr(blocks, "CELLS_PER_SHEET", most)
    again = blocks.grid_rows(t["cells"], t["blocks"], t["block_columns"], t["overrides"]), blocks.expand_blocks(*t.values())
    assert tuple(sorted(map(str, df.collect())) for df in again) == want


def test_trimmed_cells_move_only_if_some_leave(spark):
    cells = spark.createDataFrame([("c", "a", 0, 0, "x"), ("c", "b", 0, 0, "y"), (None, "a", 0, 0, "z")],
                                  "contract_id string, doc_id string, row_idx int, col_idx int, value_str string")
    documents = [("c", d, "unknown", o) for o, d in enumerate("ab")]
    for some, want in ((documents, "xy"), (documents[:1], "x")):
        kept = classify.trim_for_budget(spark.createDataFrame(some, "contract_id string, doc_id string, classification string, ord int"), cells)[1]
        assert ("Join" in kept._jdf.queryExecution().optimizedPlan().toString()) == (want == "x")
        assert "".join(sorted(r.value_str for r in kept.collect())) == want
