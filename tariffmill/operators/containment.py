"""Joins on containment as equi joins: texts in texts by their grams, numbers in ranges by dyadic bins, spans in spans by a sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
LEVELS = 31


def grams(text: Column, size: Column | int) -> Column:
    """The distinct stretches of ``size`` characters of a text at least so long."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>")
    )


def contained_pairs(needles: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, needle, text) for all distinct pairs of a group whose text contains the needle; empty needles have none.

    An inverted index: texts are listed under their grams, and a needle asks under the one of its grams that fewest texts
    of its group have, so only texts that share it are compared. A needle shorter than a gram is itself looked up among
    the shorter grams, which only groups with such needles list. No join is keyed by the group alone, so one that holds
    most rows is spread over its grams.
    """
    asked = needles.select(*keys, "needle").where(F.length("needle") > 0).distinct()
    # Grams multiply the rows, which Spark's size estimate does not see: never send them as a broadcast.
    listed = texts.select(*keys, "text").where(F.length("text") > 0).distinct().hint("merge")
    postings = listed.select(*keys, "text", F.explode(grams(F.col("text"), GRAM)).alias("gram"))
    held = postings.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("_texts"))
    own = asked.withColumn("_grams", grams(F.col("needle"), GRAM))
    rarest = (
        own.select(*keys, "needle", F.size("_grams").alias("_of"), F.explode("_grams").alias("gram")).join(held, [*keys, "gram"])
        .groupBy(*keys, "needle").agg(
            F.min(F.struct("_texts", "gram"))["gram"].alias("gram"), F.count(F.lit(1)).alias("_found"), F.first("_of").alias("_of"),
        ).where(F.col("_found") == F.col("_of")).select(*keys, "needle", "gram")
    )
    long = rarest.join(postings, [*keys, "gram"]).where(F.col("text").contains(F.col("needle"))).select(*keys, "needle", "text")
    short = asked.where(F.length("needle") < GRAM)
    shorter = F.concat(*[grams(F.col("text"), n) for n in range(1, GRAM)])
    among = listed.join(short.select(*keys).distinct(), list(keys), "left_semi").select(*keys, "text", F.explode(shorter).alias("needle")).hint("merge")
    return long.union(short.join(among, [*keys, "needle"]).select(*keys, "needle", "text"))


def bins_of(number: Column) -> Column:
    """All dyadic bins of a number from 0 on: (level, bin), one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(
        k.alias("level"), F.floor(number / F.pow(F.lit(2.0), k)).cast("bigint").alias("bin")))


def bins_over(low: Column, high: Column) -> Column:
    """The fewest dyadic bins that make up ``low`` to ``high``, two a level at most."""
    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        left, right = F.ceil(low / size).cast("bigint"), F.floor((high + 1) / size).cast("bigint")
        def bin_at(place: Column, test: Column) -> Column:
            return F.when((left < right) & test, F.struct(k.alias("level"), place.alias("bin")))
        return F.array(bin_at(left, F.pmod(left, F.lit(2)) == 1), bin_at(right - 1, F.pmod(right, F.lit(2)) == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)))


def numbers_in_ranges(ranges: DataFrame, numbers: DataFrame, keys: Sequence[str], low: str, high: str, number: str) -> DataFrame:
    """Each range joined with the numbers of its group that lie in it, by the dyadic bins of both; numbers are not negative."""
    cut = ranges.withColumn("_bin", F.explode(bins_over(F.greatest(F.col(low), F.lit(0)), F.col(high))))
    wanted = cut.select(*keys).distinct()
    placed = numbers.where(F.col(number) >= 0).join(wanted, list(keys), "left_semi").withColumn("_bin", F.explode(bins_of(F.col(number))))
    return cut.join(placed, [*keys, "_bin"]).drop("_bin")


def strictly_inside(spans: DataFrame, keys: Sequence[str], low: str, high: str, stretch: Column) -> DataFrame:
    """The distinct spans of each group that lie inside another of its spans and differ from it.

    A sweep: spans are passed by rising start and falling end; one is inside an earlier one where the furthest end so far
    reaches its own. ``stretch`` must rise with the start: furthest ends of whole stretches are carried over in short rows,
    and only one stretch of a group is sorted.
    """
    cut = spans.select(*keys, low, high).distinct().withColumn("_stretch", stretch)
    ends = cut.groupBy(*keys, "_stretch").agg(F.max(high).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(F.asc(low), F.desc(high)).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(carried, [*keys, "_stretch"]).withColumn("_so_far", F.greatest("_before", F.max(high).over(inside))).where(
        F.col("_so_far") >= F.col(high)
    ).select(*keys, low, high)
