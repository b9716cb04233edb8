"""Prices and dates are read once: no pattern may stand in the plan more often than the rule names it."""

from tariffmill.functions.dates import to_iso_date_strict
from tariffmill.functions.numbers import parse_price_cell


def test_patterns_are_tried_once_a_cell(spark):
    plan = spark.createDataFrame([("1",)], "raw string").select(parse_price_cell("raw").alias("p"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace") == 2 and text.count("RLIKE") == 4


def test_prices_and_given_numbers(spark):
    cells = [
        ("€120", None, 120.0), ("120,5", None, 120.5), ("14/06", None, None), ("4", None, None), ("-50", None, -50.0),
        ("x", 70.0, 70.0), ("x", 3.0, None), (None, None, None), ("99 EUR", None, 99.0),
    ]
    found = spark.createDataFrame(cells, "raw string, n double, want double").select("want", parse_price_cell("raw", "n").cast("double").alias("p"))
    assert [r.p for r in found.collect()] == [c[2] for c in cells]


def test_strict_dates_are_read_once(spark):
    plan = spark.createDataFrame([("1",)], "raw string").select(to_iso_date_strict("raw").alias("d"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace") == 5 and text.count("regexp_extract") == 1
