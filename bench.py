"""Wall time of the headline queries, as one JSON line.

Each query is planned and run from parquet to a sink that discards rows, after one warm-up query for the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "j1_rate_grid", "j2_coverage", "w1_dedup_rates", "w4_dedup_supplements", "w9_meal_upgrade_delta", "ex9_rate_columns",
    "ex12_child_policy_supplements", "n1_normalize_rows", "v5_provenance", "j9_cell_reconciliation", "ag8_unmapped_notes",
    "w8_rate_block_segmentation", "ex1_expand_block", "ex7_build_row_values", "ex15_text_rows", "n10_patch_fields",
    "so6_supplement_union", "j18_source_ref_lookup", "j13_metadata_enrichment", "ex17_block_documents", "t1_classify_sheets",
)


def main() -> None:
    from tariffmill.plans.catalog import queries
    from tariffmill.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog = queries()
    catalog["w15_first_seen_order"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        started = time.perf_counter()
        catalog[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
