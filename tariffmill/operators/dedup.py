"""Keyed de-duplication: one best or first row per identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import fold, is_blank, norm_label
from tariffmill.operators.containment import contained_pairs, strictly_inside
from tariffmill.operators.grid import CELL, HOTEL
from tariffmill.operators.shaping import keep_first, keep_top, null_safe
from tariffmill.schemas import OCCUPANCY_PRICES
from tariffmill.session import stage


def _filled(*names: str) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.col(name).isNotNull().cast("int")
    return total


def dedup_rates(rates: DataFrame) -> DataFrame:
    """Per (room, season, meal) the rate with most occupancy prices; the first on a tie."""
    return keep_top(rates, CELL, [_filled(*OCCUPANCY_PRICES).desc(), F.asc("ord")])


def drop_contained_seasons(seasons: DataFrame) -> DataFrame:
    """Drop a season whose dates lie inside another's, strictly at one end, and whose label is part of its label.

    Dates are compared as ISO text. Labels that hold another label of their hotel come from a gram index; the spans of all
    labels that hold a label are then swept once for it, so spans are never compared in pairs. The seasons are written once,
    because the index reads them many times and they may be the result of a long plan.
    """
    label, start, end = norm_label("label"), F.substring("start_date", 1, 10), F.substring("end_date", 1, 10)
    dated = (F.length("start_date") >= 10) & (F.length("end_date") >= 10)
    marked = stage(seasons.withColumns({"_label": label, "_from": F.when(dated, start), "_to": F.when(dated, end)}))
    spans = marked.where(dated).select(*HOTEL, "_label", "_from", "_to").distinct()
    labels = spans.select(*HOTEL, F.col("_label").alias("needle"), F.col("_label").alias("text")).distinct()
    held = contained_pairs(labels, labels, HOTEL).withColumnRenamed("text", "_label").join(spans, [*HOTEL, "_label"]).drop("_label")
    inside = strictly_inside(held, [*HOTEL, "needle"], "_from", "_to", F.substring("_from", 1, 7)).withColumnRenamed("needle", "_label")
    return marked.join(inside, [*HOTEL, "_label", "_from", "_to"], "left_anti").select(*seasons.columns)


def dedup_seasons(seasons: DataFrame) -> DataFrame:
    """First season per (label, start, end), then ``drop_contained_seasons``."""
    first = keep_first(seasons.withColumn("_label", norm_label("label")), [*HOTEL, "_label", "start_date", "end_date"])
    return drop_contained_seasons(first.drop("_label"))


def relabel_rates(rates: DataFrame, seasons: DataFrame) -> DataFrame:
    """Rates take the kept spelling of their season's label; the last kept spelling wins."""
    kept = keep_top(
        seasons.select(*HOTEL, norm_label("label").alias("_label"), F.col("label").alias("_kept"), "ord"),
        [*HOTEL, "_label"], [F.desc("ord")],
    ).drop("ord")
    return (
        rates.withColumn("_label", norm_label("season")).join(kept, [*HOTEL, "_label"], "left")
        .withColumn("season", F.coalesce("_kept", "season")).drop("_label", "_kept")
    )


def dedup_bands(bands: DataFrame) -> DataFrame:
    """First child band per (position, ages, type, value). The rooms it applies to are not part of the identity."""
    return keep_first(bands, [*HOTEL, "position", "age_from", "age_to", "value_type", "value"])


SUPPLEMENT_IDENTITY = [
    "kind", "charge_type", "calculation_method", "traveler_type", "ordinal", "age_min", "age_max", "start_date",
    "end_date",
]


def dedup_supplements(supplements: DataFrame) -> DataFrame:
    """Per hotel and identity the most complete supplement; the first on a tie. Names are rephrased and ignored."""
    keyed = supplements.withColumns({
        "_hotel": fold("hotel"), "_season": fold("season_label"),
        "_cost": F.coalesce("supplier_cost", "customer_price"),
    })
    complete = _filled("supplier_cost", "customer_price") + (~is_blank("name")).cast("int")
    return keep_top(
        keyed, ["contract_id", "_hotel", "_season", "_cost", *SUPPLEMENT_IDENTITY], [complete.desc(), F.asc("ord")]
    ).drop("_hotel", "_season", "_cost")


def merge_supplements(supplements: DataFrame, patch: DataFrame, focus: DataFrame) -> DataFrame:
    """Add the patch's supplements a hotel does not have yet, under the focus hotel's name.

    ``focus`` names one hotel per contract. Identity leaves the supplement's name out.
    """
    identity = ["contract_id", "_season", "supplier_cost", "customer_price", *SUPPLEMENT_IDENTITY]
    named = patch.join(focus.select("contract_id", F.col("hotel").alias("_focus")), "contract_id").withColumn(
        "hotel", F.when(fold("hotel") == fold("_focus"), F.col("hotel")).otherwise(F.col("_focus"))
    ).drop("_focus")
    fresh = keep_first(named.withColumn("_season", fold("season_label")), identity).alias("l")
    own = supplements.alias("s").join(focus.alias("f"), "contract_id").where(
        fold(F.col("s.hotel")) == fold(F.col("f.hotel"))
    ).select("s.*").withColumn("_season", fold("season_label")).select(*identity).distinct().alias("r")
    added = fresh.join(own, null_safe(fresh, own, identity), "left_anti").drop("_season")
    return supplements.unionByName(added, allowMissingColumns=True)


def dedup_notes(notes: DataFrame) -> DataFrame:
    """First note per (file, page, category, text)."""
    blank_as_empty = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("source_file", "page", "category")}
    keyed = notes.withColumns({**blank_as_empty, "_text": fold("note")})
    return keep_first(keyed, ["contract_id", "_source_file", "_page", "_category", "_text"]).drop(
        "_source_file", "_page", "_category", "_text"
    )


def dedup_child_columns(columns: DataFrame, keyless: str = "drop") -> DataFrame:
    """First child column per key. Keyless ones are dropped when merging, or all become CHD(Unknown)."""
    key = F.coalesce(F.nullif("key", F.lit("")), F.nullif("label", F.lit("")))
    if keyless == "drop":
        named = columns.withColumn("_key", key).where(F.col("_key").isNotNull())
        return keep_first(named, ["contract_id", "_key"]).drop("_key")
    named = columns.withColumn("key", F.coalesce(key, F.lit("CHD(Unknown)"))).withColumn(
        "label", F.coalesce("label", "key")
    )
    return keep_first(named, ["contract_id", "key"])
