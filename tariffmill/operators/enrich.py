"""Filling blanks from side tables: skeletons of a page, room facts, literals and reference data. Nothing is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, is_blank
from tariffmill.functions.numbers import parse_plain
from tariffmill.operators.shaping import keep_top, last_row
from tariffmill.schemas import CELL_META, HOTEL_HEADERS, MONEY

# Hotel-level fields a page skeleton may fill.
SKELETON_FIELDS = (
    "hotel", "supplier", "address_line_1", "country_code", "state_region", "city_area", "postal_code", "phone", "email",
    "website", "currency", "customer_currency", "rate_type",
)
# Hotel fields reference data may fill.
ENRICHED_FIELDS = (
    "address_line_1", "address_line_2", "address_line_3", "address_line_4", "postal_code", "country_code",
    "state_region", "city_area", "phone", "email", "website", "latitude", "longitude",
)
ENRICHED_CONFIDENCE = 0.3
ENRICHED_SOURCE = "metadata enrichment"
LITERAL_SOURCE = "extraAdultPolicy.perRoomLiteral"


def fill_from_skeleton(rows: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Blank hotel-level fields from the batch's skeleton; of several the last one."""
    known = last_row(skeleton, ["contract_id", "batch_id"]).select("contract_id", "batch_id", *[F.col(f).alias(f"_s_{f}") for f in SKELETON_FIELDS])
    return rows.join(known, ["contract_id", "batch_id"], "left").withColumns({
        f: F.coalesce(blank(f), blank(f"_s_{f}"), F.col(f)) for f in SKELETON_FIELDS
    }).drop(*[f"_s_{f}" for f in SKELETON_FIELDS])


def fill_room_limits(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """Blank guest limits by exact room name of the batch's skeleton; the last room of a name wins."""
    last = keep_top(rooms.where(~is_blank("room")), ["contract_id", "batch_id", "room"], [F.desc("ord")])
    limits = ("min_adult", "max_adult", "max_pax")
    known = last.select("contract_id", "batch_id", "room", *[F.col(f).alias(f"_r_{f}") for f in limits])
    return rows.join(known, ["contract_id", "batch_id", "room"], "left").withColumns({
        f: F.coalesce(F.col(f), F.col(f"_r_{f}")) for f in limits
    }).drop(*[f"_r_{f}" for f in limits])


def apply_extra_bed_literals(rows: DataFrame, literals: DataFrame) -> DataFrame:
    """The skeleton's wording overrules the row's extra bed.

    The last literal of a room wins. None, free, a percentage (flagged, priced later from the row's double rate) or the first number in the text.
    """
    known = last_row(literals, ["contract_id", "batch_id", "room"]).select(
        "contract_id", "batch_id", "room", F.upper(F.btrim(F.coalesce("literal", F.lit("")))).alias("_text"),
        F.lit(True).alias("_named"),
    )
    text = F.col("_text")
    nothing, free = text.isin("N/A", "NA", "-", ""), text.isin("FREE", "FOC", "INCLUDED")
    bare = F.btrim(F.regexp_replace(F.regexp_replace(text, "%", ""), "^-+", ""))
    percent = parse_plain(bare).cast(MONEY)
    amount = F.regexp_replace(F.regexp_substr(text, F.lit(r"-?\d+(?:[.,]\d+)?")), ",", ".").try_cast(MONEY)
    is_percent = text.contains("%") & percent.isNotNull()
    own = F.col("extra_bed").cast(MONEY)
    value = (
        F.when(F.col("_named").isNull(), own).when(nothing, F.lit(None).cast(MONEY))
        .when(free, F.lit(0).cast(MONEY)).when(is_percent, percent).when(text.contains("%"), own)
        .otherwise(F.coalesce(amount, own))
    )
    flagged = F.coalesce(F.col("_named") & ~nothing & ~free & is_percent, F.lit(False))
    sourced = F.coalesce(F.col("_named") & ~nothing & (free | is_percent), F.lit(False))
    mark = F.create_map(F.lit("extra_bed"), _meta(0.85, LITERAL_SOURCE))
    return rows.join(known, ["contract_id", "batch_id", "room"], "left").withColumns({
        "extra_bed": value, "extra_bed_is_pct": flagged,
        "cell_meta": F.when(sourced, _merged(F.col("cell_meta"), mark)).otherwise(F.col("cell_meta")),
    }).drop("_text", "_named")


def _meta(confidence: float, source: str, inferred: bool | None = None) -> Column:
    return F.struct(
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source_ref"),
        F.lit(inferred).cast("boolean").alias("ai_inferred"), F.lit(None).cast("boolean").alias("user_edited"),
    )


def _merged(old: Column, new: Column) -> Column:
    kept = F.map_filter(F.coalesce(old, F.create_map().cast(CELL_META)), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def enrichment_gaps(rows: DataFrame, force: bool = False) -> DataFrame:
    """Per hotel and field whether a row has a value, the first one, and whether it should be looked up."""
    named = rows.withColumn("hotel", F.btrim("hotel")).where(~is_blank("hotel"))
    firsts = named.groupBy("contract_id", "hotel").agg(*[
        F.min_by(F.col(f).cast("string"), F.when(~is_blank(F.col(f).cast("string")), F.col("ord"))).alias(f)
        for f in ENRICHED_FIELDS
    ])
    long = firsts.unpivot(["contract_id", "hotel"], list(ENRICHED_FIELDS), "field", "known")
    return long.withColumn("missing", F.lit(force) | F.col("known").isNull())


def enrich_metadata(rows: DataFrame, reference: DataFrame, force: bool = False) -> DataFrame:
    """Blank hotel fields from a reference table, the last row of a hotel's name, each fill with warning and mark.

    A field that some row of the hotel already has is not looked up unless ``force`` is set.
    """
    wanted = enrichment_gaps(rows, force).where("missing").groupBy("contract_id", "hotel").agg(
        F.collect_set("field").alias("_wanted")
    )
    named = last_row(reference.withColumn("_name", F.btrim("hotel")), ["_name"])
    offered = named.select("_name", *[_coerced(f).alias(f"_e_{f}") for f in ENRICHED_FIELDS])
    joined = (
        rows.withColumn("_name", F.btrim("hotel"))
        .join(wanted.withColumnRenamed("hotel", "_name"), ["contract_id", "_name"], "left")
        .join(offered, "_name", "left")
    )
    fills = {
        f: is_blank(F.col(f).cast("string")) & F.coalesce(F.array_contains("_wanted", f), F.lit(False))
        & F.col(f"_e_{f}").isNotNull()
        for f in ENRICHED_FIELDS
    }
    filled = F.array_compact(F.array(*[F.when(test, F.lit(f)) for f, test in fills.items()]))
    headers = F.create_map(*[F.lit(x) for f in ENRICHED_FIELDS for x in (f, HOTEL_HEADERS[f].strip())])
    told = F.transform("_filled", lambda f: F.concat(
        F.lit("'"), headers[f], F.lit("' filled by reference lookup (AI-inferred) — verify before export")
    ))
    marks = F.map_from_arrays(F.col("_filled"), F.transform(
        "_filled", lambda f: _meta(ENRICHED_CONFIDENCE, ENRICHED_SOURCE, True)
    ))
    return joined.withColumn("_filled", filled).withColumns({
        **{f: F.when(test, F.col(f"_e_{f}").cast(_type(rows, f))).otherwise(F.col(f)) for f, test in fills.items()},
        "warnings": F.array_union(F.coalesce("warnings", F.array().cast("array<string>")), told),
        "cell_meta": F.when(F.size("_filled") > 0, _merged(F.col("cell_meta"), marks)).otherwise(F.col("cell_meta")),
    }).select(*rows.columns)


def _type(df: DataFrame, name: str):
    return df.schema[name].dataType


def _coerced(field: str) -> Column:
    value = F.col(field)
    if field in ("latitude", "longitude"):
        return value.cast("string").try_cast("double")
    if field == "country_code":
        code = F.upper(F.btrim(value))
        return F.when(F.length(code) >= 2, F.substring(code, 1, 2))
    return F.when(~is_blank(value), F.btrim(value))


def uncovered_rooms(rooms: DataFrame, rows: DataFrame, n: int | None = None) -> DataFrame:
    """The skeleton rooms of a batch no row mentions, or the next ``n`` of them."""
    batch = ["contract_id", "batch_id"]
    covered = rows.select(*batch, "room").where(F.col("room").isNotNull()).distinct()
    open_rooms = rooms.where(~is_blank("room")).join(covered, [*batch, "room"], "left_anti")
    return open_rooms if n is None else keep_top(open_rooms, batch, [F.asc("ord")], n)
