"""Child price columns and child age bands: order, labels, bands and the three child slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, is_blank
from tariffmill.functions.pricing import classify_band, position_ordinal
from tariffmill.operators.shaping import keep_first, keep_top

BANDS = ("baby", "child", "teen")


def sort_key() -> list[Column]:
    """ST1's order: ages with unknown ones last, then child position, then label."""
    position = F.coalesce(position_ordinal("position"), F.when(F.col("position").isNull(), 4).otherwise(5))
    label = F.coalesce(blank("label"), blank("key"), F.lit(""))
    return [F.asc_nulls_last("age_from"), F.asc_nulls_last("age_to"), position.asc(), label.asc()]


def sort_child_columns(columns: DataFrame) -> DataFrame:
    """ST1: ``ord`` becomes the column's place within its contract; equal columns keep their source order.

    The window runs over a contract's distinct child columns, of which there is one per age band, not over its rows.
    """
    w = Window.partitionBy("contract_id").orderBy(*sort_key(), F.asc("ord"))
    return columns.withColumn("ord", F.row_number().over(w))


def label_columns(columns: DataFrame) -> DataFrame:
    """The label is the key with the unit of percentage columns."""
    unit = (
        F.when(F.col("value_type") == "discount_percentage", " (% off)")
        .when(F.col("value_type") == "percentage_of_adult", " (% of adult)")
        .otherwise("")
    )
    return columns.withColumn("label", F.concat(F.coalesce(blank("key"), blank("label"), F.lit("")), unit))


def normalize_columns(columns: DataFrame) -> DataFrame:
    """Child columns as the row pass needs them: sorted, one per key, defaults filled, labelled."""
    key = F.coalesce(blank("key"), blank("label"), F.lit("CHD(Unknown)"))
    named = columns.withColumn("_key", key)
    first = keep_top(named, ["contract_id", "_key"], [*sort_key(), F.asc("ord")]).withColumn("key", F.col("_key")).drop(
        "_key"
    )
    filled = first.withColumn("label", F.coalesce("label", "key")).withColumn(
        "value_type", F.coalesce("value_type", F.lit("unknown"))
    )
    return label_columns(sort_child_columns(filled))


def band_assignment(columns: DataFrame) -> DataFrame:
    """AG6: per contract and band the first and second key in source order and the band's age range."""
    keyed = columns.where(~is_blank("key")).withColumn("band", classify_band("age_from", "age_to"))
    ages = keyed.groupBy("contract_id", "band").agg(F.min("age_from").alias("age_from"), F.max("age_to").alias("age_to"))
    two = keep_top(keyed, ["contract_id", "band"], [F.asc("ord")], 2, rank_as="_place").groupBy(
        "contract_id", "band"
    ).agg(
        F.max(F.when(F.col("_place") == 1, F.col("key"))).alias("primary"),
        F.max(F.when(F.col("_place") == 2, F.col("key"))).alias("secondary"),
    )
    return ages.join(two, ["contract_id", "band"])


def position_assignment(table: DataFrame, group: Sequence[str], demote_repeats: bool = True) -> DataFrame:
    """Rows of child columns or bands dealt to slots 1 to 3 of their group.

    An explicit position takes its slot, first come. Rows without one fill the lowest free slots in order; a repeated
    explicit position joins them when ``demote_repeats`` is set and is dropped otherwise. Only the first three leftovers
    of a group can matter, so no group is gathered whole.
    """
    group = list(group)
    slotted = table.withColumn("slot", position_ordinal("position"))
    named = keep_first(slotted.where(F.col("slot").isNotNull()), [*group, "slot"])
    free = F.array_except(F.array(F.lit(1), F.lit(2), F.lit(3)), F.coalesce("_used", F.array().cast("array<int>")))
    used = named.groupBy(*group).agg(F.collect_set("slot").alias("_used"))
    loose = slotted.where(F.col("slot").isNull())
    if demote_repeats:
        taken = named.select(*group, "slot", F.col("ord").alias("_taken"))
        repeats = slotted.where(F.col("slot").isNotNull()).join(taken, [*group, "slot"]).where(
            F.col("ord") != F.col("_taken")
        ).drop("_taken")
        loose = loose.unionByName(repeats)
    dealt = (
        keep_top(loose, group, [F.asc("ord")], 3, rank_as="_place")
        .join(used, group, "left")
        .withColumn("slot", F.get(free, F.col("_place") - 1))
        .where(F.col("slot").isNotNull())
        .drop("_place", "_used")
    )
    return named.unionByName(dealt)
