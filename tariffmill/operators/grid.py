"""The room x season x meal grid of each hotel: expansion, coverage and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import is_blank
from tariffmill.operators.shaping import group_product, keep_first, keep_top
from tariffmill.schemas import OCCUPANCY_PRICES

HOTEL = ["contract_id", "hotel"]
CELL = [*HOTEL, "room", "season", "meal"]


def is_priced() -> Column:
    """True when any of the four occupancy prices is present."""
    return F.coalesce(*[F.col(f) for f in OCCUPANCY_PRICES]).isNotNull()


ROOM_ATTRIBUTES = ("bed_type", "min_adult", "max_adult", "max_pax", "max_rollaways", "max_cribs")
SEASON_ATTRIBUTES = ("start_date", "end_date", "min_stay", "release_period")
MEAL_ATTRIBUTES = ("canonical",)


def grid_keys(rooms: DataFrame, seasons: DataFrame, meals: DataFrame, attributes: bool = False) -> DataFrame:
    """Every (room, season, meal) of each hotel with the three source ordinals, on request with their attributes."""
    def extra(names: tuple[str, ...]) -> tuple[str, ...]:
        return names if attributes else ()

    short_axes = group_product(
        seasons.select(
            *HOTEL, F.col("label").alias("season"), F.col("ord").alias("season_ord"), *extra(SEASON_ATTRIBUTES)
        ),
        meals.select(*HOTEL, F.col("code").alias("meal"), F.col("ord").alias("meal_ord"), *extra(MEAL_ATTRIBUTES)),
        HOTEL, ["season", "season_ord"],
    )
    return group_product(
        rooms.select(*HOTEL, "room", F.col("ord").alias("room_ord"), *extra(ROOM_ATTRIBUTES)),
        short_axes, HOTEL, ["room", "room_ord"],
    )


def rate_grid(
    rooms: DataFrame, seasons: DataFrame, meals: DataFrame, rates: DataFrame, attributes: bool = False,
) -> DataFrame:
    """The grid left-joined to rates. Cells without a rate stay, with null prices; the last duplicate rate wins."""
    last = keep_top(rates, CELL, [F.desc("ord")]).drop("ord")
    return grid_keys(rooms, seasons, meals, attributes).join(last, CELL, "left")


def coverage(rooms: DataFrame, seasons: DataFrame, meals: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected and filled cells per hotel with gaps. Counted from the axes; the grid is not expanded.

    ``filled`` counts every priced key, on the grid or not, so the ratio can exceed one.
    """
    axes = [
        (rooms.where(~is_blank("room")), "room", "room"),
        (seasons.where(~is_blank("label")), "label", "season"),
        (meals.where(~is_blank("code")), "code", "meal"),
    ]
    priced = rates.where(is_priced()).select(*CELL).distinct()
    expected, on_grid, times = None, priced, F.lit(1)
    for table, name, key in axes:
        entries = table.groupBy(*HOTEL, F.col(name).alias(key)).agg(F.count(F.lit(1)).alias(f"_times_{key}"))
        size = entries.groupBy(*HOTEL).agg(F.sum(f"_times_{key}").alias(f"_n_{key}"))
        expected = size if expected is None else expected.join(size, HOTEL)
        on_grid = on_grid.join(entries, [*HOTEL, key], "left")
        times = times * F.coalesce(F.col(f"_times_{key}"), F.lit(0))
    filled = on_grid.groupBy(*HOTEL).agg(
        F.count(F.lit(1)).alias("filled"), F.sum(times).alias("_on_grid")
    )
    return (
        expected.join(filled, HOTEL, "left")
        .select(
            *HOTEL,
            (F.col("_n_room") * F.col("_n_season") * F.col("_n_meal")).alias("expected"),
            F.coalesce("filled", F.lit(0)).alias("filled"),
            F.coalesce("_on_grid", F.lit(0)).alias("_on_grid"),
        )
        .withColumn("missing", F.col("expected") - F.col("_on_grid"))
        .where(F.col("missing") > 0)
        .withColumn("ratio", F.col("filled") / F.col("expected"))
        .withColumn("severity", F.when(F.col("ratio") < 0.5, "error").otherwise("warning"))
        .drop("_on_grid")
    )


def missing_rates(rooms: DataFrame, seasons: DataFrame, meals: DataFrame, rates: DataFrame) -> DataFrame:
    """The grid cells no priced rate fills."""
    named = grid_keys(
        rooms.where(~is_blank("room")), seasons.where(~is_blank("label")), meals.where(~is_blank("code"))
    )
    return named.join(rates.where(is_priced()).select(*CELL).distinct(), CELL, "left_anti")


def fill_missing_rates(rates: DataFrame, patch: DataFrame, missing: DataFrame) -> DataFrame:
    """Add the patch's priced rates for missing cells, first per cell; present prices are never replaced."""
    wanted = (
        patch.where(is_priced())
        .join(missing.select(*CELL).distinct(), CELL, "left_semi")
        .join(rates.where(is_priced()).select(*CELL).distinct(), CELL, "left_anti")
    )
    return rates.unionByName(keep_first(wanted, CELL), allowMissingColumns=True)


def fill_grid_gaps(rates: DataFrame, patch: DataFrame, rooms: DataFrame, seasons: DataFrame, meals: DataFrame) -> DataFrame:
    """J3 straight from the axes: a patch cell is missing if its room, season and meal are its hotel's and no rate prices it.

    The same rows as ``fill_missing_rates`` with ``missing_rates``, but the grid is not expanded.
    """
    wanted = patch.where(is_priced())
    for axis, name, key in ((rooms, "room", "room"), (seasons, "label", "season"), (meals, "code", "meal")):
        own = axis.where(~is_blank(name)).select(*HOTEL, F.col(name).alias(key)).distinct()
        wanted = wanted.join(own, [*HOTEL, key], "left_semi")
    wanted = wanted.join(rates.where(is_priced()).select(*CELL).distinct(), CELL, "left_anti")
    return rates.unionByName(keep_first(wanted, CELL), allowMissingColumns=True)


def coverage_issues(covered: DataFrame) -> DataFrame:
    """V8: coverage as validation issues."""
    percent = F.format_string("%.0f%%", F.round(F.col("ratio") * 100, 0))
    message = F.concat(
        F.lit("Rate matrix coverage for hotel '"), F.col("hotel"), F.lit("': "), F.col("filled").cast("string"),
        F.lit("/"), F.col("expected").cast("string"), F.lit(" priced ("), percent, F.lit("). "),
        F.col("missing").cast("string"), F.lit(" (room, season, meal) combinations are missing rates."),
    )
    return covered.select(*HOTEL, F.lit("MISSING_RATES").alias("code"), "severity", message.alias("message"), "missing")


def _triple() -> Column:
    return F.concat(F.lit("('"), F.col("room"), F.lit("', '"), F.col("season"), F.lit("', '"), F.col("meal"), F.lit("')"))


def retry_triples(missing: DataFrame) -> DataFrame:
    """ST2 in long form: every missing cell of a hotel as the triple a retry asks for."""
    return missing.select(*HOTEL, "room_ord", "season_ord", "meal_ord", _triple().alias("triple"))


def retry_directives(missing: DataFrame, preview: int) -> DataFrame:
    """ST2 as one text a hotel for a caller's request: its first ``preview`` missing cells and how many more there are."""
    triple = _triple()
    order = F.struct("room_ord", "season_ord", "meal_ord", "room", "season", "meal")
    counts = missing.groupBy(*HOTEL).agg(F.count(F.lit(1)).alias("missing"))
    shown = keep_top(
        missing.select(*HOTEL, order.alias("_at"), triple.alias("_text")), HOTEL, [F.asc("_at")], preview
    ).groupBy(*HOTEL).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda s: s["_text"]), "; ")
        .alias("triples")
    )
    more = F.col("missing") - preview
    overflow = F.when(more > 0, F.concat(
        F.lit(" Plus "), more.cast("string"),
        F.lit(" more (room, season, meal_code) combinations following the same pattern."),
    )).otherwise("")
    return counts.join(shown, HOTEL).select(*HOTEL, "missing", F.concat("triples", F.lit("."), overflow).alias("text"))
