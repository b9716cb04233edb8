"""Table rules on small fixtures with known results."""

from pyspark.sql import functions as F

from tariffmill.operators import audit, blocks, child_columns, classify, dedup, enrich, grid, mapping, merge, normalize, review, shaping, text_rows, validate
from tariffmill.schemas import CELL_META

ROOMS = "contract_id string, hotel string, room string, code string, bed_type string, min_adult int, max_adult int, max_pax int, max_rollaways int, max_cribs int, max_children int, ord int"
SEASONS = "contract_id string, hotel string, label string, start_date string, end_date string, min_stay int, release_period int, ord int"
MEALS = "contract_id string, hotel string, code string, canonical string, ord int"
RATES = "contract_id string, hotel string, room string, season string, meal string, sgl decimal(12,2), dbl decimal(12,2), tpl decimal(12,2), qdp decimal(12,2), extra_bed_adult decimal(12,2), extra_bed_adult_kind string, ord bigint"
BANDS = "contract_id string, hotel string, position string, label string, age_from decimal(5,2), age_to decimal(5,2), value_type string, value decimal(12,2), applies_to_rooms array<string>, ord int"
HOTELS = "contract_id string, hotel string, code string, supplier string, currency string, ord int"


def room(name, ord_, hotel="H", **more):
    return ("c", hotel, name, None, None, more.get("min_adult", 1), more.get("max_adult", 2), more.get("max_pax", 2), None, None, more.get("max_children"), ord_)


def season(label, ord_, start="2025-05-01", end="2025-09-30", hotel="H"):
    return ("c", hotel, label, start, end, None, None, ord_)


def meal(code, ord_, canonical=None, hotel="H"):
    return ("c", hotel, code, canonical or code, ord_)


def rate(r, s, m, ord_, sgl=None, dbl=None, hotel="H"):
    return ("c", hotel, r, s, m, sgl, dbl, None, None, None, None, ord_)


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_grid_and_coverage(table):
    rooms, seasons, meals = table(ROOMS, [room("A", 0), room("B", 1)]), table(SEASONS, [season("S1", 0), season("S2", 1)]), table(MEALS, [meal("BB", 0)])
    rates = table(RATES, [rate("A", "S1", "BB", 0, dbl=10), rate("A", "S2", "BB", 1, dbl=11), rate("B", "S1", "BB", 2, dbl=12), rate("B", "S2", "BB", 3)])
    assert pairs(grid.missing_rates(rooms, seasons, meals, rates), "room", "season", "meal") == [("B", "S2", "BB")]
    cover = grid.coverage(rooms, seasons, meals, rates).collect()[0]
    assert (cover["expected"], cover["filled"], cover["missing"], cover["severity"]) == (4, 3, 1, "warning")
    assert grid.coverage(rooms, seasons, table(MEALS, []), rates).count() == 0
    full = grid.rate_grid(rooms, seasons, meals, rates.unionByName(table(RATES, [rate("A", "S1", "BB", 9, dbl=99)])))
    assert sorted((r["room"], r["season"], None if r["dbl"] is None else float(r["dbl"])) for r in full.collect()) == [("A", "S1", 99), ("A", "S2", 11), ("B", "S1", 12), ("B", "S2", None)]
    patch = table(RATES, [rate("B", "S2", "BB", 0), rate("B", "S2", "BB", 1, dbl=7), rate("B", "S2", "BB", 2, dbl=8), rate("A", "S1", "BB", 3, dbl=1)])
    filled = grid.fill_missing_rates(rates, patch, grid.missing_rates(rooms, seasons, meals, rates))
    assert filled.count() == 5 and filled.where("dbl = 7").count() == 1
    off_grid = grid.coverage(rooms, seasons, meals, rates.unionByName(table(RATES, [rate("Z", "S1", "BB", 5, dbl=1), rate("Z", "S2", "BB", 6, dbl=1)])))
    assert off_grid.collect()[0]["ratio"] == 1.25


def test_large_group_product_is_whole(spark):
    left = spark.range(2500).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    right = spark.range(7).select(F.lit("k").alias("k"), F.col("id").alias("b"))
    assert shaping.group_product(left, right, ["k"], ["a"]).distinct().count() == 2500 * 7


def test_prefix_sum_matches_plain_running_total(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), (F.col("id") * 37 % 1000).alias("o"), (F.col("id") % 5).alias("v"))
    got = {(r["k"], r["o"]): r["s"] for r in shaping.prefix_sum(df, ["k"], "o", F.col("v"), "s", width=64).collect()}
    rows = sorted((r["k"], r["o"], r["v"]) for r in df.collect())
    total, last = 0, None
    for k, o, v in rows:
        total, last = (v, k) if k != last else (total + v, k)
        assert got[(k, o)] == total


def test_child_policy_rows(table):
    hotels = table(HOTELS, [("c", "H", "X1", "[AI] Sup", None, 0)])
    rooms = table(ROOMS, [room("Standard", 0), room("Deluxe", 1)])
    rates = table(RATES, [rate("Standard", "S", "BB", 0, dbl=43), rate("Standard", "S2", "BB", 1, dbl=79), rate("Deluxe", "S", "BB", 2, dbl=60), rate("Deluxe", "S2", "BB", 3, dbl=100)])
    bands = table(BANDS, [("c", "H", "second_child", None, 2, 11.99, "discount_percentage", 50, None, 0)])
    rows = mapping.child_policy_supplements(hotels, rooms, rates, bands)
    assert pairs(rows, "rooms", "supplier_cost", "supplement_code") == [("Deluxe", "30.00", "CHILD-2-2-11.99"), ("Standard", "21.50", "CHILD-2-2-11.99")]
    assert {tuple(r["ai_fields"]) for r in rows.collect()} == {("Supplier",)}
    low = table(RATES, [rate("Standard", "S", "BB", 0, dbl=40), rate("Deluxe", "S", "BB", 1, dbl=3)])
    costs = mapping.child_policy_supplements(hotels, rooms, low, table(BANDS, [("c", "H", None, None, 6, 10.99, "discount_percentage", 50, None, 0)]))
    assert {r["supplier_cost"] for r in costs.collect()} == {"20.00"}
    scoped = table(BANDS, [("c", "H", "first_child", None, 0, 12.99, "discount_percentage", 100, [" deluxe "], 0), ("c", "H", None, None, 0, 1, "amount", 5, ["Castle"], 1)])
    assert pairs(mapping.bands_per_room(scoped, rooms), "ord", "room") == [(0, "Deluxe"), (1, "Deluxe"), (1, "Standard")]
    assert pairs(mapping.bands_per_room(scoped, table(ROOMS, [])), "ord", "room") == [(0, "ALL"), (1, "ALL")]


def test_meal_upgrades(table):
    hotels, rooms = table(HOTELS, [("c", "H", None, "Sup", "EUR", 0)]), table(ROOMS, [room("A", 0)])
    meals, seasons = table(MEALS, [meal("BB", 0, "Bed and Breakfast"), meal("HB", 1, "Half board")]), table(SEASONS, [season("S", 0)])
    rates = table(RATES, [rate("A", "S", "BB", 0, dbl=43), rate("A", "S", "HB", 1, dbl=59)])
    row = mapping.meal_upgrade_rows(rates, hotels, rooms, seasons, meals).collect()
    assert len(row) == 1
    assert (row[0]["supplement_code"], row[0]["supplier_cost"], row[0]["traveler_type"], row[0]["standard_count_index"]) == ("SUP-HB", "16.00", "Adult", None)
    assert row[0]["description"] == "Half board supplement over Bed and Breakfast" and row[0]["start_date"] == "01-05-2025"
    equal = table(RATES, [rate("A", "S", "BB", 0, dbl=43), rate("A", "S", "HB", 1, dbl=43), rate("A", "S", "AI", 2)])
    assert mapping.meal_upgrade_deltas(equal).count() == 0


SUPPLEMENTS = ("contract_id string, hotel string, name string, kind string, charge_type string, calculation_method string, traveler_type string, ordinal int, "
               "age_min decimal(5,2), age_max decimal(5,2), supplier_cost decimal(12,2), customer_price decimal(12,2), season_label string, start_date string, end_date string, ord int")


def supplement(ord_, name="Gala", hotel="A", cost=50, price=None, date="2025-12-24"):
    return ("c", hotel, name, "gala_dinner", "Per Person Per Stay", "Standard", "Adult", None, None, None, cost, price, None, date, date, ord_)


def test_supplement_dedup(table):
    df = table(SUPPLEMENTS, [supplement(0, "X- Mass Gala"), supplement(1, "X-Mass Gala"), supplement(2, date="2025-12-31"), supplement(3, hotel="B")])
    assert pairs(dedup.dedup_supplements(df), "ord") == [(0,), (2,), (3,)]
    complete = table(SUPPLEMENTS, [supplement(0, cost=15), supplement(1, cost=15, price=15), supplement(2, cost=None, price=15)])
    assert pairs(dedup.dedup_supplements(complete), "ord") == [(1,)]
    once = dedup.dedup_supplements(df)
    assert pairs(dedup.dedup_supplements(once), "ord") == pairs(once, "ord")


def test_season_containment(table):
    df = table(SEASONS, [
        season("01/04-13/06 & 15/09-31/10", 0, "2025-04-01", "2025-10-31"), season("15/09-31/10", 1, "2025-09-15", "2025-10-31"),
        season("14/06-31/08", 2, "2025-06-14", "2025-08-31"), season("15/09-31/10", 3, None, "2025-10-31"),
    ])
    assert pairs(dedup.drop_contained_seasons(df), "ord") == [(0,), (2,), (3,)]


def test_rate_votes(table):
    parts = table("contract_id string, part_idx int, detected_rate_type string", [("c", 0, "PRN"), ("c", 1, "PPN"), ("c", 2, "PPN")])
    rates = table(RATES + ", part_idx int", [(*rate("A", str(i), "BB", i, dbl=1), 1 + i % 2) for i in range(20)] + [(*rate("A", "x", "BB", 99), 0)])
    assert merge.rate_type_vote(parts, rates).collect()[0]["detected_rate_type"] == "PPN"


def test_child_slots(table):
    ddl = "contract_id string, key string, position string, ord int"
    df = table(ddl, [("c", "a", None, 0), ("c", "b", "second_child", 1), ("c", "d", "second_child", 2), ("c", "e", None, 3), ("c", "f", None, 4)])
    assert pairs(child_columns.position_assignment(df, ["contract_id"]), "slot", "key") == [(1, "a"), (2, "b"), (3, "d")]
    assert pairs(child_columns.position_assignment(df, ["contract_id"], demote_repeats=False), "slot", "key") == [(1, "a"), (2, "b"), (3, "e")]


def _sheet(table, lines, doc="Sheet:x"):
    ddl = "contract_id string, doc_id string, row_idx int, col_idx int, value_str string, value_num double, value_type string"
    cells = []
    for r, line in enumerate(lines):
        for c, v in enumerate(line):
            if v is not None:
                number = float(v) if isinstance(v, (int, float)) else None
                cells.append(("c", doc, r, c, str(v), number, "n" if number is not None else "s"))
    return table(ddl, cells)


HEADER = ["FROM", "TO", "DBL", "Release", "Booking Window"]


def test_rate_blocks(table):
    data = ["01/05/2025", "31/10/2025", 62, 70, 80]
    sheet = _sheet(table, [["Hotel"], ["Currency", "EUR"], [None, " "], ["Contract Rate"], HEADER, data, ["Booking Window 30 days"], HEADER, data])
    rows = blocks.rate_blocks(sheet).collect()
    assert {(r["block_idx"], r["title"]) for r in rows} == {(0, "contract rate"), (1, "booking window 30 days")}
    assert sorted((r["block_idx"], r["row_idx"], r["line"]) for r in rows if r["is_preamble"]) == [(b, i, i + 1) for b in (0, 1) for i in (0, 1, 2)]
    assert [r["line"] for r in rows if r["row_idx"] == 6] == [4]
    plain = blocks.rate_blocks(_sheet(table, [["Hotel"], HEADER, data])).collect()
    assert {(r["block_idx"], r["title"], r["block_count"]) for r in plain} == {(0, None, None)}
    texts = {r["block_doc_id"]: r["raw_excerpt"] for r in blocks.block_documents(sheet, classify.classify_sheets(sheet)).collect()}
    assert set(texts) == {"Sheet:x"} or "Sheet:x | contract rate" in texts
    lines = blocks.sheet_text(_sheet(table, [["a", None, "b\tc\nd"], [None, "  "], ["e"]])).collect()[0]["text"].split("\n")
    assert lines == ["=== Sheet: x ===", "Row\tA\tB\tC", "1\ta\t\tb c / d", "3\te\t\t"]


BLOCK_COLUMNS = "contract_id string, doc_id string, block_idx int, role string, col_idx int, label string, position string, age_from decimal(5,2), age_to decimal(5,2), value_type string, supp_field string, ord int"


def test_block_expansion(table):
    rows = [[f"2025-0{i + 1}-01", f"2025-0{i + 1}-28", b, 0.7, 2, 0.5, 3, 10] for i, b in enumerate((40, 38, 40, 50))]
    cells = _sheet(table, [["h"]] + rows)
    roles = [("date_from", 0, None), ("date_to", 1, None), ("base_room", 2, "SUPERIOR GV"), ("sgl_supp", 3, None), ("tpl_reduct", 4, None), ("child", 5, None),
             ("upgrade", 6, "SUP PV"), ("upgrade", 7, "Beach Front")]
    columns = table(BLOCK_COLUMNS, [
        ("c", "Sheet:x", 0, role, i, label, "first_child" if role == "child" else None, 0 if role == "child" else None, 5.99 if role == "child" else None, None, None, i)
        for i, (role, _, label) in enumerate(roles)
    ])
    block = table("contract_id string, doc_id string, block_idx int, title string, first_data_row_idx int, last_data_row_idx int", [("c", "Sheet:x", 0, None, 1, 9)])
    overrides = table("contract_id string, doc_id string, position string, age_from decimal(5,2), age_to decimal(5,2), ord int", [])
    occupancy = table("contract_id string, doc_id string, room_name string, min_adult int, max_adult int, max_pax int, max_child int, ord int",
                      [("c", "Sheet:x", "SUP GV", 1, 3, 3, 1, 0), ("c", "Sheet:x", "SUP PV", 1, 2, 2, 0, 1), ("c", "Sheet:x", "FAM SSV", 2, 4, 4, 2, 2)])
    meta = table("contract_id string, doc_id string, name string, supplier string, country_code string, state_or_region string, city_or_area string, currency string, rate_type string, stars string, basic_treatment string",
                 [("c", "Sheet:x", "Hotel", None, None, None, None, "EUR", None, None, "HB")])
    options = table("contract_id string, supplier string, country string, city_area string, currency string, status string, check_in string, check_out string",
                    [("c", "Sup", "GR", None, "USD", None, None, None)])
    got = blocks.expand_blocks(cells, block, columns, overrides, occupancy, meta, options).collect()
    assert len(got) == 12
    by = {(r["row_idx"], r["room"]): r for r in got}
    first = by[(1, "SUPERIOR GV")]
    assert [float(first[c]) for c in ("dbl", "sgl", "tpl")] == [40, 68, 38] and first["max_pax"] == 3
    assert [float(by[(1, "SUP PV")][c]) for c in ("dbl", "sgl")] == [43, 73.1]
    assert [float(by[(1, "Beach Front")][c]) for c in ("dbl", "sgl")] == [50, 85] and by[(1, "Beach Front")]["max_pax"] is None
    assert {k: None if v is None else float(v) for k, v in first["child_values"].items()} == {"CHD1(0-5.99)": 0.5}
    assert by[(1, "SUP PV")]["child_values"] == {"CHD1(0-5.99)": None} and len(by[(1, "SUP PV")]["warnings"]) == 1
    assert (first["currency"], first["supplier"], first["status"], first["meal_plan"], first["confidence"]) == ("EUR", "Sup", "Open", "Half Board", 0.92)
    narrowed = blocks.narrow_child_ages(columns, table("contract_id string, doc_id string, position string, age_from decimal(5,2), age_to decimal(5,2), ord int", [
        ("c", "Sheet:x", "first_child", 2, 5.99, 0), ("c", "Sheet:x", "first_child", 0, 5.99, 1), ("c", "Sheet:x", "first_child", 0, 7, 2)]))
    assert pairs(narrowed.where("role = 'child'").select(F.col("age_from").cast("double"), F.col("age_to").cast("double")), "age_from", "age_to") == [(2.0, 5.99)]


def _rows(table, rows):
    ddl = ("contract_id string, row_id string, hotel string, room string, sheet string, sgl decimal(12,2), dbl decimal(12,2), tpl decimal(12,2), qdp decimal(12,2), "
           "extra_bed decimal(12,2), child_values map<string,double>, ord int")
    df = table(ddl, rows)
    return df.withColumn("child_values", F.transform_values("child_values", lambda k, v: v.cast("decimal(12,2)")))


def test_share_columns_become_amounts(table):
    rows = _rows(table, [("c", "1", "H", "A", "p", None, 40, None, None, None, {"k": 1.0, "x": 50.0}, 0), ("c", "2", "H", "A", "p", None, 60, None, None, None, {"k": 0.5, "x": None}, 1)])
    columns = table("contract_id string, key string, label string, value_type string", [("c", "k", "k (%)", "unknown"), ("c", "x", "x", "amount")])
    typed = normalize.detect_percentage_columns(rows, columns)
    assert pairs(typed, "key", "value_type") == [("k", "percentage_of_adult"), ("x", "amount")]
    got = {r["row_id"]: {k: None if v is None else float(v) for k, v in r["child_values"].items()} for r in normalize.discount_to_amount(rows, typed).collect()}
    assert got == {"1": {"k": 40.0, "x": 50.0}, "2": {"k": 30.0, "x": None}}
    assert pairs(normalize.columns_as_amounts(typed), "key", "label", "value_type") == [("k", "k", "amount"), ("x", "x", "amount")]


def test_end_year_repair(table):
    df = table("start_date string, end_date string, warnings array<string>", [("2026-04-10", "2025-05-03", None), ("2026-04-10", "2026-04-09", None), ("2026-04-10", "2025-03-01", [])])
    got = normalize.repair_end_year(df).collect()
    assert [r["end_date"] for r in got] == ["2026-05-03", "2026-04-09", "2025-03-01"] and [len(r["warnings"]) for r in got] == [1, 0, 0]


def test_price_list_audit(table):
    prices = [["€62,00", "€34,00", "€43,00", "€54,00"], ["€78,00", "€50,00", "€59,00", "€70,00"]]
    names = ["Double for Single", "Double", "Superior", "Family"]
    cells = table("contract_id string, doc_id string, table_idx int, row_idx int, col_name string, raw string", [
        ("c", "Page:1", 0, i, n, v) for i, row in enumerate(prices) for n, v in zip(names, row)
    ] + [("c", "Page:1", 0, i, "Period", "01.04.2026 - 13.06.2026 & 15.09.2026 - 31.10.2026") for i in (0, 1)] + [("c", "Page:1", 0, i, "Board", b) for i, b in enumerate(("BB", "HB"))])
    rows = _rows(table, [("c", "1", "H", "A", "Page:1", 62, 34, None, None, None, {}, 0), ("c", "2", "H", "A", "Page:1", 78, 50, None, None, None, {}, 1)])
    unmapped = audit.unmapped_cells(cells, rows)
    assert unmapped.count() == 4
    notes = audit.unmapped_notes(unmapped).collect()
    assert {n["note"].split("column ")[1].split(" ")[0] for n in notes} == {"'Superior'", "'Family'"}
    stats = audit.audit_stats(cells, rows).collect()[0]
    assert (stats["source_price_cells"], stats["mapped_price_values"], stats["unmapped_cells"], stats["rows_without_prices"]) == (8, 4, 4, 0)
    sized = audit.rate_dimensions(cells).collect()[0]
    assert (sized["rooms"], sized["periods"], sized["boards"]) == (4, 1, 2)
    docs = table("contract_id string, doc_id string, classification string, source_ref string", [("c", "Page:1", "hotel_contract", "r")])
    assert audit.completeness_notes(cells, docs, rows).count() == 1
    ranged = rows.withColumn("sheet", F.lit("Pages:1-2"))
    assert audit.completeness_notes(cells, docs, ranged.unionByName(ranged)).count() == 0


def test_extra_bed_literals(table):
    ddl = "contract_id string, batch_id string, room string, extra_bed decimal(12,2), dbl decimal(12,2)"
    rows = table(ddl, [("c", "b", r, 9, 60) for r in ("A", "B", "D", "E", "F", "G")]).withColumn("cell_meta", F.create_map().cast(CELL_META))
    literals = table("contract_id string, batch_id string, room string, literal string", [("c", "b", "A", "25 EUR"), ("c", "b", "B", "-30%"), ("c", "b", "D", "free"), ("c", "b", "E", "n/a"), ("c", "b", "F", "later")])
    got = {r["room"]: (None if r["extra_bed"] is None else float(r["extra_bed"]), r["extra_bed_is_pct"], len(r["cell_meta"])) for r in enrich.apply_extra_bed_literals(rows, literals).collect()}
    assert got == {"A": (25, False, 0), "B": (30, True, 1), "D": (0, False, 1), "E": (None, False, 0), "F": (9, False, 0), "G": (9, False, 0)}


def test_text_without_ages_names_one_child_column(table):
    docs = table("contract_id string, doc_id string, raw_excerpt string, ord int", [("c", "1", "child discounts", 0), ("d", "2", "CHD(2-11.99) child", 0), ("e", "3", "adults", 0)])
    assert pairs(text_rows.text_child_columns(docs), "contract_id", "key") == [("c", "CHD(Child)"), ("d", "CHD(2-11.99)")]


def test_generated_workbook(table):
    from pyspark.sql import functions as F
    lines = [["Sunrise Hotel"], [], ["Currency", "EUR"], ["Meal Plan", "BB"], [], ["FROM", "TO", "Room", "DBL", "SGL", "CHD(2-11.99)", "CHD(0-1.99)"],
             ["01/05/2025", "31/10/2025", "Standard Double", 120, 180, 60, 0], ["01/11/2025", "31/03/2026", "Standard Double", 90, 130, 45, 0], [],
             ["Cancellation: 30 days prior to arrival no charge, 15 days 50%"], ["Gala dinner 24/12: 80 EUR per adult, 40 EUR per child"]]
    cells = _sheet(table, lines, "Sheet:Sunrise").unionByName(_sheet(table, [["Hotel", "Destination", "Country"]], "Sheet:Hotel List"))
    sheets = classify.classify_sheets(cells)
    assert {r["doc_id"]: r["classification"] for r in sheets.collect()} == {"Sheet:Sunrise": "hotel_contract", "Sheet:Hotel List": "index_reference"}
    docs = blocks.block_documents(cells, sheets).select("contract_id", F.col("block_doc_id").alias("doc_id"), "classification", "detected_hotel_name", "raw_excerpt",
                                                        F.lit("excel_sheet").alias("kind"), F.lit("f").alias("source_ref"), F.lit(0).alias("ord"))
    options = table("contract_id string, supplier string, country string, city_area string, currency string, status string, check_in string, check_out string", [("c", "S", "GR", "A", None, None, None, None)])
    rows, notes, columns = text_rows.extract_from_text(docs, options)
    assert pairs(rows, "hotel", "start_date", "end_date", "currency", "meal_plan") == [
        ("Sunrise Hotel", "2025-05-01", "2025-10-31", "EUR", "Bed & Breakfast"), ("Sunrise Hotel", "2025-11-01", "2026-03-31", "EUR", "Bed & Breakfast")]
    assert {k for (k,) in pairs(columns, "key")} == {"CHD(2-11.99)", "CHD(0-1.99)"}
    assert {"Cancellation", "Gala dinner"} <= {c for (c,) in pairs(notes, "category")}
    checked = rows.withColumns({"row_id": F.col("start_date"), "rate_type": F.lit(None).cast("string")})
    assert validate.row_issues(checked, ("required_fields",)).where("field = 'Room Name'").count() == 2


def test_golden_diff_of_a_result_with_itself_is_empty(table):
    df = _rows(table, [("c", "1", "H", "A", "p", 1, 2, None, None, None, {"k": 1.0}, 0), ("c", "2", "H", "A", "p", 1, 2, None, None, None, {"k": 1.0}, 1)])
    assert merge.golden_diff(df, df.withColumn("row_id", F.lit("other"))).count() == 0
    assert [r["surplus"] for r in merge.golden_diff(df, df.where("ord = 0")).collect()] == [1]


def test_trim_by_format(table):
    docs = table("contract_id string, doc_id string, ord int, classification string, input_format string, raw_excerpt string", [
        ("c", f"d{i:02}", i, "hotel_contract", kind, "x" * 10_001) for i, kind in enumerate(["pdf", "PDF", "docx", "other", None] * 9)
    ])
    cells = table("contract_id string, doc_id string, row_idx int, col_idx int, value_str string", [
        ("c", doc, row, col, "v") for doc in ("d00", "d02", "d03", "d41") for row, col in ((119, 39), (120, 0), (199, 39), (200, 0), (0, 40))
    ])
    kept, inside = classify.trim_for_budget(docs, cells, classify.REQUEST_DOCUMENTS, classify.FORMAT_CAPS)
    sizes = {r["doc_id"]: len(r["raw_excerpt"]) for r in kept.collect()}
    told = len("\n...[truncated]")
    assert len(sizes) == 40 and {sizes[f"d{i:02}"] for i in (0, 1)} == {10_000 + told} and sizes["d02"] == 10_001
    assert sizes["d03"] == sizes["d04"] == 8000 + told
    assert {(r["doc_id"], r["row_idx"], r["col_idx"]) for r in inside.collect()} == {
        ("d00", 119, 39), *((d, row, col) for d in ("d02", "d03") for row, col in ((119, 39), (120, 0), (199, 39)))
    }


def test_parts_are_united_whole(table):
    first = table("contract_id string, hotel string, part_idx int, ord int, city string", [("c", "H", 0, 1, None), ("c", "", 0, 2, "x")])
    second = table("contract_id string, hotel string, part_idx int, ord int, city string, phone string", [("c", "H", 1, 1, "Nice", "1")])
    hotels = merge.unite_parts(first, second)
    rooms = merge.unite_parts(*[table("contract_id string, hotel string, part_idx int, ord int, room string", [("c", n, p, 1, r)]) for n, p, r in (("H", 0, "A"), ("H", 1, "B"), (None, 1, "C"))])
    notes = table("contract_id string, source_file string, page string, category string, note string, ord int", [("c", "f", "p", "k", t, i) for i, t in enumerate(("N", "n "))])
    columns = table("contract_id string, key string, label string, ord int", [("c", "k", "l", 1), ("c", "k", "m", 2)])
    issues = table("contract_id string, severity string, ord int", [("c", "info", 1), ("c", "error", 2), ("c", "other", 3)])
    summaries = table("contract_id string, part_idx int, confidence double, source_file string, input_format string", [("c", 0, 0.5, None, "pdf"), ("c", 1, 1.0, "f", "xlsx")])
    entries = table("contract_id string, list string, entry string, ord int", [("c", "sheets", "S", 1), ("c", "sheets", "S", 2), ("c", "sheets", "T", 3)])
    out = merge.merge_chunks(issues, notes, columns, issues, summaries, entries, hotels, ("city", "phone"), {"rooms": rooms, "rate_blocks": rooms, "child_policies": rooms})
    assert {n: df.count() for n, df in out.items()} == {
        "rows": 3, "issues": 3, "notes": 1, "child_columns": 1, "summary": 1, "summary_lists": 2, "hotels": 2, "rooms": 3, "rate_blocks": 3, "child_policies": 3,
    }
    assert {(r["hotel"], r["city"], r["phone"]) for r in out["hotels"].collect()} == {("H", "Nice", "1"), ("Unknown Hotel", "x", None)}
    assert {(r["hotel"], r["room"]) for r in out["rooms"].collect()} == {("H", "A"), ("H", "B"), ("Unknown Hotel", "C")}
    whole = merge.aggregate_contract(hotels, {"rooms": rooms})
    assert whole["hotels"].count() == 1 and whole["rooms"].count() == 3
    assert [(r["group_rank"], r["ord"]) for r in review.grouped_issues(issues).orderBy("group_rank").collect()] == [(0, 2), (2, 1)]


def test_block_lines_make_up_the_documents(table):
    data = ["01/05/2025", "31/10/2025", 62, 70, 80]
    sheet = _sheet(table, [["Hotel"], ["Currency", "EUR"], ["Contract Rate"], HEADER, data, ["Booking Window 30 days"], HEADER, data])
    sheets = classify.classify_sheets(sheet).withColumn("classification", F.lit("hotel_contract"))
    lines = {}
    for r in blocks.block_lines(sheet, sheets).orderBy("block_idx", "line").collect():
        lines.setdefault(r["block_doc_id"], []).append(r["text"])
    texts = {r["block_doc_id"]: r["raw_excerpt"].split("\n")[2:] for r in blocks.block_documents(sheet, sheets).collect()}
    assert len(lines) == 2 and lines == texts
