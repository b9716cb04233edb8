"""Export sheets as projections, and their writers as partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.functions.base import blank
from tariffmill.functions.dates import real_date
from tariffmill.functions.names import slugify
from tariffmill.operators.shaping import first_by
from tariffmill.schemas import (
    DROPPED_CHILD_HEADERS, HOTEL_HEADERS, NOTE_HEADERS, NUMERIC_FIELDS, STRICT_CHILD_KEYS, SUPP_HEADERS,
    SUPPLEMENT_HEADERS, SUPPLEMENT_TYPES,
)
from tariffmill.sinks.versions import VersionedTable

UNKNOWN_HOTEL = "Unknown Hotel"


def _cell(rows: DataFrame, name: str) -> Column:
    if name not in rows.columns:
        return F.lit(None).cast("string")
    if name in ("start_date", "end_date"):
        return real_date(F.substring(name, 1, 10))
    if name in NUMERIC_FIELDS:
        return F.col(name)
    return F.when(F.btrim(F.col(name).cast("string")) != "", F.col(name))


def export_hotel(rows: DataFrame, child_keys: list[str] | None = None, mode: str = "dynamic_export") -> DataFrame:
    """SNK1: 44 base columns, the child columns, 4 supplement columns, and 3 internal ones in review mode.

    ``child_keys`` are the export's child columns in order (a sheet has few); strict mode has five of its own.
    """
    keys = list(STRICT_CHILD_KEYS) if mode == "strict_template" else list(child_keys or [])
    columns = [_cell(rows, n).alias(h) for n, h in HOTEL_HEADERS.items()]
    columns += [F.try_element_at("child_values", F.lit(k)).alias(k) for k in keys]
    columns += [_cell(rows, n).alias(h) for n, h in SUPP_HEADERS.items()]
    if mode == "dynamic_review":
        columns += [
            F.array_join("source_refs", "; ").alias("_source_refs"), F.col("confidence").alias("_confidence"),
            F.array_join("warnings", "; ").alias("_warnings"),
        ]
    return rows.select("contract_id", *columns)


def used_child_keys(rows: DataFrame) -> DataFrame:
    """SNK2's column list: per hotel the child keys that have a value in some row. One short row per hotel and key."""
    return rows.select(
        "contract_id", F.coalesce(blank("hotel"), F.lit(UNKNOWN_HOTEL)).alias("hotel"),
        F.explode("child_values").alias("key", "_v"),
    ).where(F.col("_v").isNotNull()).select("contract_id", "hotel", "key").distinct()


def export_per_hotel(rows: DataFrame) -> DataFrame:
    """SNK2: the rows of contracts with several hotels, under each hotel, child values cut to the hotel's used keys."""
    named = rows.withColumn("hotel_sheet", F.coalesce(blank("hotel"), F.lit(UNKNOWN_HOTEL)))
    several = named.groupBy("contract_id").agg(
        (F.min("hotel_sheet") != F.max("hotel_sheet")).alias("_several")
    ).where("_several").select("contract_id")
    used = used_child_keys(rows).groupBy("contract_id", F.col("hotel").alias("hotel_sheet")).agg(
        F.array_sort(F.collect_set("key")).alias("child_keys")
    )
    return (
        named.join(several, "contract_id", "left_semi").join(used, ["contract_id", "hotel_sheet"], "left")
        .withColumn("child_keys", F.coalesce("child_keys", F.array().cast("array<string>")))
        .withColumn("child_values", F.map_filter("child_values", lambda k, v: F.array_contains(F.col("child_keys"), k)))
    )


def export_notes(notes: DataFrame) -> DataFrame:
    """SNK3: four columns, nulls as empty text."""
    return notes.select(
        "contract_id", *[F.coalesce(F.col(n), F.lit("")).alias(h) for n, h in NOTE_HEADERS.items()]
    )


def export_supplements(rows: DataFrame) -> DataFrame:
    """SNK4: the 34 columns; unknown columns are dropped, missing ones blank. No rows still make a table."""
    return rows.select("contract_id", *[
        (F.col(n) if n in rows.columns else F.lit(None)).cast(SUPPLEMENT_TYPES.get(n, "string")).alias(h)
        for n, h in SUPPLEMENT_HEADERS.items()
    ])


def export_raw_rows(rows: DataFrame, headers: list[str]) -> DataFrame:
    """SNK5: rows that already carry printed headers: the layout's columns only, without internal and child columns."""
    dropped = set(DROPPED_CHILD_HEADERS)
    wanted = [h for h in headers if h not in dropped and not h.startswith("_")]
    return rows.select("contract_id", *[
        (F.col(f"`{h}`") if h in rows.columns else F.lit(None).cast("string")).alias(h) for h in wanted
    ])


def unmapped_strict_children(rows: DataFrame) -> DataFrame:
    """SO4: in a strict export, one note per child value that has no column."""
    spread = rows.select(
        "contract_id", "sheet", "hotel", "room", "start_date", "end_date", "row_id", "source_refs", "confidence",
        F.explode("child_values").alias("key", "value"),
    ).where(F.col("value").isNotNull() & ~F.col("key").isin(*STRICT_CHILD_KEYS))
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("None"))

    return spread.select(
        "contract_id", F.coalesce("sheet", F.lit("—")).alias("page"), F.lit("Child policy").alias("category"), F.concat(
            F.lit("Strict template export dropped child column '"), "key", F.lit("' (value: "),
            F.col("value").cast("string"), F.lit(") for hotel "), shown("hotel"), F.lit(" / "), shown("room"),
            F.lit(" "), shown("start_date"), F.lit(" – "), shown("end_date"),
        ).alias("note"), "source_refs", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "hotel",
        F.col("row_id").alias("linked_row_id"),
    )


def supplier_templates(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """SNK6: the structure last seen of each supplier, in long form: one row per distinct room, period, meal and child
    column with its first place, plus the first row's currency and rate type.

    Long form keeps a supplier with very many rooms out of any single row; distinct values are reduced before the
    shuffle. ``first_seen`` orders the entries.
    """
    owned = rows.where(~F.coalesce(blank("supplier").isNull(), F.lit(True))).withColumn(
        "supplier_slug", slugify("supplier")
    )
    period = F.concat_ws("/", "start_date", "end_date")
    dated = blank("start_date").isNotNull() & blank("end_date").isNotNull()
    facts = owned.select("supplier_slug", "ord", F.inline(F.array_compact(F.array(
        _fact("room", blank("room")), _fact("period", F.when(dated, period)), _fact("meal_plan", blank("meal_plan")),
    )))).groupBy("supplier_slug", "kind", "value").agg(F.min("ord").alias("first_seen"))
    heads = owned.groupBy("supplier_slug").agg(
        first_by("currency").alias("currency"), first_by("rate_type").alias("rate_type")
    ).select("supplier_slug", F.inline(F.array_compact(F.array(
        _fact("currency", F.col("currency")), _fact("rate_type", F.col("rate_type")),
    )))).withColumn("first_seen", F.lit(0).cast("bigint"))
    slugs = owned.select("contract_id", "supplier_slug").distinct()
    children = columns.select("contract_id", F.col("key").alias("value"), F.col("ord").cast("bigint").alias("ord")).join(
        slugs, "contract_id"
    ).groupBy("supplier_slug", F.lit("child_column").alias("kind"), "value").agg(F.min("ord").alias("first_seen"))
    return facts.unionByName(heads).unionByName(children)


def _fact(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))


def attach_supplier_templates(options: DataFrame, templates: DataFrame) -> DataFrame:
    """SNK7: options with the entries stored for their supplier; contracts of unknown suppliers keep one plain row."""
    slug = F.when(blank("supplier").isNotNull(), slugify("supplier"))
    return options.withColumn("supplier_slug", slug).join(templates, "supplier_slug", "left")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write one export. Partition columns are clustered first so each directory gets few files, with hot ones split."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    # Static whatever the session says: what an earlier export left of hotels since renamed or deleted must go.
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "static")
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def template_store(spark: SparkSession, path: str) -> VersionedTable:
    """SNK6 and SNK7: the stored templates by supplier; ``load`` gives the latest or an earlier version."""
    return VersionedTable(spark, path, ["supplier_slug"])


def save_supplier_templates(templates: DataFrame, path: str) -> int:
    """SNK6: the templates replace the stored ones of the suppliers at hand, as a new version of the store.

    All others stay, and until the version is committed, or where the save fails, readers see the version before it.
    """
    return template_store(templates.sparkSession, path).save(templates)


def write_supplier_templates(templates: DataFrame, path: str) -> None:
    """SNK6 as plain partitions, overwritten in place, for readers that know no versions."""
    writer = templates.hint("rebalance", "supplier_slug").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    )
    writer.partitionBy("supplier_slug").parquet(path)
