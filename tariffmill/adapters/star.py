"""The contract tables of one star-schema folder as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.adapters.star_views import sql_with_views
from tariffmill.schemas import CELL_META

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
# Each order becomes several long rows here, which Spark's estimate from the file does not know: it would send the whole
# table through the driver as a broadcast. These sides are always shuffled.
SHUFFLED = {
    "cells", "head_cells", "blocks", "block_columns", "overrides", "occupancy", "sheet_meta", "sheet_options", "sheets",
    "sheet_hotels",
}
CHILD_KEYS = {"chd1": "CHD1(2-11.99)", "chd2": "CHD2(0-5.99)", "chd3": "CHD(12-17.99)"}


class StarData:
    """Reads parquet tables of one folder and projects them into contract tables on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        query = sql_with_views(f"SELECT * FROM {name}", "spark")
        # Names are bound while the query is analysed, so each call names this folder's tables anew.
        for table in set(BASE_TABLES) & set(re.findall(r"\w+", query)):
            if table not in self._tables:
                self._tables[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
            self._tables[table].createOrReplaceTempView(table)
        rows = self.spark.sql(query)
        return rows.hint("merge") if name in SHUFFLED else rows

    def __getattr__(self, name: str) -> DataFrame:
        shape = _SHAPES.get(name)
        return shape(self) if shape else self.view(name)


def _rows(star: StarData) -> DataFrame:
    """Clean gen-1 rows with their map, list and mark columns."""
    ai = F.struct(
        F.lit(0.3).alias("confidence"), F.lit("x").alias("source_ref"), (F.col("city_mark") == "ai").alias("ai_inferred"),
        (F.col("city_mark") == "user").alias("user_edited"),
    )
    return star.view("rows").withColumns({
        "child_values": _child_map(),
        "source_refs": F.array_compact(F.array("ref")),
        "warnings": F.array_compact(F.array("warning")),
        "cell_meta": F.when(F.col("city_mark").isNotNull(), F.create_map(F.lit("city_area"), ai)).otherwise(
            F.create_map().cast(CELL_META)
        ),
        "review_state": F.lit("auto"),
        "batch_id": F.concat(F.lit("batch "), F.col("batch_no").cast("string")),
    }).drop("ref", "warning", "city_mark", "batch_no", *CHILD_KEYS)


def _raw_rows(star: StarData) -> DataFrame:
    """Gen-1 rows as read: text in every field, children included, one key no column declares."""
    pairs = [x for c, k in CHILD_KEYS.items() for x in (F.lit(k), F.col(c))]
    return star.view("raw_rows").withColumns({
        "child_values": F.create_map(*pairs, F.lit("CHD(99)"), F.lit("1")),
        "source_refs": F.array("ref"),
        "warnings": F.array().cast("array<string>"),
        "cell_meta": F.create_map().cast(CELL_META),
        "review_state": F.lit(None).cast("string"),
    }).drop("ref", *CHILD_KEYS)


def _child_map():
    return F.create_map(*[x for c, k in CHILD_KEYS.items() for x in (F.lit(k), F.col(c))])


def _bands(star: StarData) -> DataFrame:
    names = F.transform(F.split("rooms_text", ","), lambda r: r)
    return star.view("child_bands").withColumn("applies_to_rooms", names).drop("rooms_text")


_SHAPES = {"rows": _rows, "raw_rows": _raw_rows, "child_bands": _bands}
