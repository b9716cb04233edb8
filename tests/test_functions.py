"""Scalar rules on single values."""

import pytest
from pyspark.sql import functions as F

from tariffmill.functions import dates, names, numbers, pricing, vocabulary


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


CASES = [
    (vocabulary.normalize_currency, ["euro", "US$ 5", "£", "chf", "??", None, ""], ["EUR", "USD", "GBP", "CHF", None, None, None]),
    (vocabulary.normalize_meal_plan, ["ai", "ULTRA AI", "Ultra All Inclusive plus", "European", "Bed & Breakfast", "Picnic", ""],
     ["All Inclusive", "Ultra All Inclusive", "All Inclusive", "Room Only", "Bed & Breakfast", "Picnic", None]),
    (vocabulary.normalize_status, ["on request", "LIVE", "gone"], ["On Request", "Open", None]),
    (vocabulary.detect_meal_plan, ["rates AI", "maïs AIÉ", "half board only"], ["All Inclusive", None, "Half Board"]),
    (dates.normalize_iso_date, ["2026-4-1T00:00", "1/5/25", "31-12-2025", "2026-02-30", "1.2.202", "soon"],
     ["2026-04-01", "2025-05-01", "2025-12-31", "2026-02-30", "0202-02-01", None]),
    (dates.to_iso_date_strict, ["2026-02-30", "01/02-2025", "01.02.2025", "2026-02-28 x"], [None, None, "2025-02-01", "2026-02-28"]),
    (dates.format_day_first, ["2025-05-01", "05/2025", "", None], ["01-05-2025", "05/2025", None, None]),
    (dates.days_mask, ["0,6", "1,2,3,4,5", "0 to 6", "1-5", "67", None, "weekdays"],
     ["67", "12345", "1234567", "12345", "67", "1234567", "1234567"]),
    (names.slugify, ["Travel Center  Ltd.", "--", " É "], ["travel-center-ltd", "unknown-supplier", "unknown-supplier"]),
    (names.is_index_sheet, ["Hotel List", "sheet12", "Hotel Listing"], [True, True, False]),
    (lambda c: F.array_sort(names.room_tokens(c)), ["Fam SSV", "DLX SWIM UP", "SUPERIOR GV", None],
     [["family", "seasideview"], ["deluxe", "swim", "up"], ["gardenview", "superior"], []]),
    (lambda c: names.page_numbers(c, F.lit(6)), ["1-3, 5", "9", "5-2", None, "4-99999999999"],
     [[1, 2, 3, 5], [1, 2, 3, 4, 5, 6], [2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [4, 5, 6]]),
    (names.detect_child_keys, ["CHD(2-11.99) chd 0 - 1.99, CHD (2 to 11.99)", "children"], [["CHD(2-11.99)", "CHD(0-1.99)"], []]),
    (lambda c: F.transform(dates.date_pairs(c), lambda p: F.concat_ws(">", p["start_date"], p["end_date"])),
     ["1.1.26-7.1.26 and 2025-05-01, 2025-06-01, 3/3/25", "none 2-11.99"], [["2026-01-01>2026-01-07", "2025-03-03>2025-05-01"], []]),
    (vocabulary.meal_from_treatment, ["HB", "Bed or breakfast", "hai", "picnic"], ["Half Board", "Bed & Breakfast", "All Inclusive", "Picnic"]),
]


@pytest.mark.parametrize("fn,given,wanted", CASES, ids=[str(i) for i in range(len(CASES))])
def test_text_rules(spark, fn, given, wanted):
    assert values(spark, given, fn) == wanted


def test_prices_of_source_cells(spark):
    given = ["62", "€62,00", "62.00 EUR", "130,00", "n/a", "free", "-50%", "FOC", "1", "999999", "14/06-31/08", "3 | 10", "9" * 81, "5 rooms"]
    got = values(spark, given, numbers.parse_price_cell)
    assert [None if v is None else float(v) for v in got] == [62, 62, 62, 130] + [None] * 10


def test_numbers_and_prose(spark):
    given = ["1,234.50", "62,00", "free", "n/a", "-50%", "tax included", " 7 ", "", None, "2.7", "50 %"]
    got = values(spark, given, numbers.coerce_number)
    assert [None if v["num"] is None else float(v["num"]) for v in got] == [1234.5, 6200, 0, None, 50, None, 7, None, None, 2.7, 50]
    assert [v["prose"] for v in got] == [None] * 5 + ["tax included"] + [None] * 5
    whole = values(spark, given, lambda c: numbers.coerce_number(c, integer=True)["num"])
    assert [whole[0], whole[9]] == [1234, 2]
    free = values(spark, ["FOC"], lambda c: numbers.coerce_number(c, value_type=F.lit("discount_percentage"))["num"])
    assert float(free[0]) == 100
    assert [None if v is None else float(v) for v in values(spark, ["62,00", "0,7", "50%", "FREE", "€ 5"], numbers.to_float)] == [62, 0.7, 50, None, 5]


def test_hotel_code_is_base36_of_md5(spark):
    import hashlib
    name = "Grand Hotel"
    n = int(hashlib.md5(name.lower().encode()).hexdigest()[:8], 16) % 36 ** 6
    digits = ""
    for _ in range(6):
        n, r = divmod(n, 36)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + digits
    assert values(spark, [name, "  GRAND hotel ", "", None], names.hotel_code) == [digits, digits, "000000", "000000"]


def test_band_prices(table):
    df = table("t string, v decimal(12,2), a decimal(12,2)", [
        ("discount_percentage", 50, 43), ("discount_percentage", 100, None), ("percentage_of_adult", 100, 43), ("percentage_of_adult", 75, 40),
        ("amount", 12, None), ("not_applicable", 5, 40), ("discount_percentage", None, 40),
    ])
    got = [r[0] for r in df.select(pricing.band_price("t", "v", "a")).collect()]
    assert [None if v is None else float(v) for v in got] == [21.5, 0, 0, 30, 12, None, None]


def test_child_keys_and_occupancy_prices(table):
    df = table("p string, f decimal(5,2), t decimal(5,2)", [("first_child", 2, 11.99), (None, 0, None), ("third_child", 10, 12.5)])
    assert [r[0] for r in df.select(pricing.child_key("p", "f", "t")).collect()] == ["CHD1(2-11.99)", "CHD(0-?)", "CHD3(10-12.5)"]
    priced = table("b decimal(12,2), s decimal(12,2), r decimal(12,2)", [(40, 0.7, 2), (40, 10, 0.3), (40, None, None)])
    got = priced.select(pricing.occupancy_prices("b", "s", "r", "r").alias("p")).select("p.sgl", "p.tpl").collect()
    assert [tuple(None if v is None else float(v) for v in r) for r in got] == [(68, 38), (50, 28), (None, None)]


def test_real_dates_need_no_format_per_value(spark, table):
    """a day is cast, not read by a pattern, whose failures cost the most; shapes and calendar hold as before."""
    cases = {"2024-02-29": "2024-02-29", "2026-02-30": None, "2024-2-9": None, "2024-01-01\n": None, " 2024-01-01": None, "": None, None: None}
    df = table("iso string", [(c,) for c in cases]).select("iso", dates.real_date("iso").cast("string").alias("d"))
    assert {r.iso: r.d for r in df.collect()} == cases
    assert "yyyy-MM-dd" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_date_rules_count_days_once(spark, table):
    """both date rules read one count of days."""
    from tariffmill.operators.validate import date_rules

    rows = [("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-01"), ("2024-01-01", "2023-02-30"), ("", "x"), (None, None)]
    df = table("start_date string, end_date string", rows)
    plan = df.select(F.array_compact(F.array(*date_rules())).alias("i"))
    assert [[i.field for i in r.i] for r in plan.collect()] == [[], ["End Date"], ["Start Date"], [], []]
    assert str(plan._jdf.queryExecution().optimizedPlan().toString()).lower().count("datediff") == 1
