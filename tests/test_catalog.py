"""Catalog queries against their SQL on the smallest folder; all of them when CATALOG=all is set."""

import os

import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from oracle.statements import oracle_sql
from tariffmill.adapters.star import StarData
from tariffmill.operators import merge, review
from tariffmill.plans.catalog import queries
from tariffmill.plans.pipelines import process_rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "j1_rate_grid", "j2_coverage", "j3_fill_missing_rates", "w1_dedup_rates", "w4_dedup_supplements", "w7_position_assignment", "w10_chunk_assignment",
    "ag1_dominant_rate_type", "ag8_unmapped_notes", "n5_discount_to_amount", "n10_patch_fields", "v2_dates", "t1_classify_sheets", "j16_sheet_match",
    "snk6_supplier_template_save", "fn7_coerce_number", "fn13_hotel_code", "src5_vision_tables",
)
NAMES = sorted(queries()) if os.environ.get("CATALOG") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) == []


def test_rows_pipeline(spark):
    star = StarData(spark, FOLDER)
    raw = star.raw_rows.withColumn("rate_plan", F.lit("Contract"))
    out = process_rows(raw, star.child_columns, star.options, star.page_docs, star.source_cells)
    rows = out["rows"]
    assert rows.count() == 6000
    assert rows.where("size(child_values) = 0").count() == 0
    assert out["issues"].where("severity = 'error'").count() > 0
    assert {r["category"] for r in out["notes"].select("category").distinct().collect()} == {"Rate anomaly", "Child policy", "Source ambiguity"}


def test_one_contract_holding_everything(spark):
    """All documents in one contract: places and chunks stay exact when the group spans many stretches."""
    docs = spark.range(3000).select(
        F.lit("c").alias("contract_id"), F.concat(F.lit("d"), "id").alias("doc_id"), (F.col("id") * 101).alias("ord"),
        F.when(F.col("id") % 10 == 0, "index_reference").otherwise("hotel_contract").alias("classification"),
    )
    chunks = merge.chunk_documents(docs, 900)
    sizes = {r["chunk_idx"]: r["count"] for r in chunks.where("classification = 'hotel_contract'").groupBy("chunk_idx").count().collect()}
    assert sizes == {0: 900, 1: 900, 2: 900}
    assert chunks.where("classification = 'index_reference'").count() == 300 * 3


def test_group_limits_run_below_the_shuffle(spark):
    plan = queries()["w1_dedup_rates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    status = review.row_issue_counts(StarData(spark, FOLDER).issues)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan + status and "NestedLoop" not in plan + status
