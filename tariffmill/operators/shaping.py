"""Group-wise building blocks that stay parallel when one group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Left rows of one slice of a per-group product.
LEFT_ROWS_PER_SLICE = 1_000
# Characters of one value of an assembled text.
CHUNK_CHARACTERS = 1_000_000


def keep_top(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1, rank_as: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group, with their 1-based rank when ``rank_as`` names a column for it.

    Spark turns the rank filter into a group limit below the shuffle, so every task sends at most ``n`` rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rank = rank_as or "_rank"
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: str | Column = "ord") -> DataFrame:
    """One row per group, the one with the lowest source ordinal. Null keys form a group of their own."""
    return keep_top(df, keys, [F.asc(order) if isinstance(order, str) else order])


def last_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: that of the highest ``ord``, or without such a column the greatest row, so that it is definite."""
    order = [F.desc("ord")] if "ord" in df.columns else []
    return keep_top(df, keys, [*order, *[F.desc_nulls_last(c) for c, kind in df.dtypes if c not in keys and not kind.startswith("map")]])


def prefix_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = 65_536,
) -> DataFrame:
    """Running total of ``value`` up to and including each row, by the integer column ``order`` inside each group.

    Two levels: totals per stretch of ``width`` ordinals are added up first (one short row per stretch), then each
    stretch is summed on its own. A group is never sorted as a whole. Keys must not be null.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_value", value.cast("bigint"))
    totals = cut.groupBy(*keys, "_stretch").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_stretch", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, "_stretch"])
        .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
        .drop("_stretch", "_value", "_before")
    )


def text_chunks(lines: DataFrame, keys: Sequence[str], order: str, characters: int) -> DataFrame:
    """Texts put together from ``text`` lines in the order of an integer column, in chunks: keys, chunk from 0, text.

    A line belongs to the chunk in which it begins, so a chunk has at most ``characters`` and its last line; the chunks one
    after the other are the whole text, and a very long line leaves the numbers of the chunks it covers out. Only one
    chunk's lines are ever gathered.
    """
    sized = prefix_sum(lines.select(*keys, order, "text"), keys, order, F.length("text"), "_end")
    return gathered_text(sized.select(*keys, order, "text", F.floor((F.col("_end") - F.length("text")) / characters).alias("chunk")), keys, order)


def gathered_text(lines: DataFrame, keys: Sequence[str], order: str, facts: Sequence[str] = ()) -> DataFrame:
    """The text of each ``chunk`` of lines; ``facts``, the same in all lines of a group, go along.

    Lines are dealt before they are gathered: gathering on the sending side would sort and spill every line and merge few.
    """
    return lines.repartition(*keys, "chunk").groupBy(*keys, "chunk").agg(*[F.max(c).alias(c) for c in facts], F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "text"))), lambda line: line["text"]), "").alias("text"))


def group_rank(df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = 65_536) -> DataFrame:
    """1-based position of each row in its group by a distinct integer ordinal; see ``prefix_sum``."""
    return prefix_sum(df, keys, order, F.lit(1), out, width)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, mark: Column, out: str, width: int = 8_192,
    groups: DataFrame | None = None, gate: Column | None = None,
) -> DataFrame:
    """The last mark at or before each row, by the integer column ``order`` inside each group.

    ``mark`` is a struct, null where a row opens nothing. New columns: ``out`` (the carried mark or null), ``{out}_no`` (how
    many marks so far), ``{out}_first`` and ``{out}_count`` (first mark and number of the whole group). A segmented scan: each stretch of ``width``
    ordinals is summed up in one short row (its marks' number and last one), these rows of a group, ordered in one array,
    give what is carried over each stretch's end, and only a stretch is ever sorted. Keys must not be null.

    A column ``_stretch`` that ``df`` is already dealt by is used instead of ``width``, so its rows are not moved again.
    ``groups`` has facts of whole groups, one row each, which come along; where ``gate`` on them fails a group has no marks.
    Groups that are not among them leave.
    """
    cut = (df if "_stretch" in df.columns else df.withColumn("_stretch", F.floor(F.col(order) / width))).withColumn("_mark", mark)
    marked = F.col("_mark").isNotNull()
    sums = cut.groupBy(*keys, "_stretch").agg(
        F.count_if(marked).alias("n"), F.max_by("_mark", F.when(marked, F.col(order))).alias("last"),
        F.min_by("_mark", F.when(marked, F.col(order))).alias("first"),
    )
    stretches = F.array_sort(F.collect_list(F.struct(F.col("_stretch").alias("stretch"), "n", "last")))

    def carried(s: Column, i: Column) -> Column:
        before = F.slice("_all", F.lit(1), i)
        return F.struct(
            s["stretch"].alias("_stretch"), F.aggregate(before, F.lit(0).cast("bigint"), lambda t, e: t + e["n"]).alias("_no"),
            F.get(F.reverse(F.filter(before, lambda e: e["n"] > 0)), F.lit(0))["last"].alias("_last"),
            F.col("_count"), F.col("_first"),
        )

    whole = sums.groupBy(*keys).agg(
        stretches.alias("_all"), F.sum("n").alias("_count"), F.min_by("first", F.when(F.col("n") > 0, F.col("_stretch"))).alias("_first")
    )
    facts = []
    if groups is not None:
        whole, facts = whole.join(groups, list(keys)), [c for c in groups.columns if c not in keys]
    over = whole.select(*keys, *facts, F.inline(F.transform("_all", carried)))
    if gate is not None:
        none = F.coalesce(~gate, F.lit(True))
        over = over.withColumns({"_no": F.when(none, 0).otherwise(F.col("_no")), "_count": F.when(none, 0).otherwise(F.col("_count")),
                                 "_last": F.when(~none, F.col("_last")), "_first": F.when(~none, F.col("_first")), "_none": none})
        joined = cut.join(over, [*keys, "_stretch"]).withColumn("_mark", F.when(~F.col("_none"), F.col("_mark"))).drop("_none")
    else:
        joined = cut.join(over, [*keys, "_stretch"])
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({
        out: F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_last")),
        f"{out}_no": F.col("_no") + F.sum(marked.cast("bigint")).over(inside),
    }).withColumnsRenamed({"_count": f"{out}_count", "_first": f"{out}_first"}).drop("_stretch", "_mark", "_no", "_last")


def group_product(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Every left row with every right row of its group: an equi join whose large groups are cut into slices.

    Left rows are dealt to slices of about ``LEFT_ROWS_PER_SLICE`` rows by the hash of ``spread_by``; right rows are
    repeated once per slice. A giant group's product so spreads over many tasks; usual groups have one slice. Only the
    left side is counted, so pass the side that is cheaper to read.
    """
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LEFT_ROWS_PER_SLICE).cast("int").alias("_slices"))
    dealt = left.join(sizes, list(keys)).withColumn(
        "_slice", F.pmod(F.xxhash64(*spread_by), F.col("_slices")).cast("int")
    ).drop("_slices")
    repeated = right.join(sizes, list(keys)).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    ).drop("_slices")
    return dealt.join(repeated, [*keys, "_slice"]).drop("_slice")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition that treats null keys as equal. The sides must be aliased ``l`` and ``r``."""
    condition = None
    for key in keys:
        test = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        condition = test if condition is None else condition & test
    return condition


def first_by(value: Column | str, order: Column | str = "ord", where: Column | None = None) -> Column:
    """Aggregate: the value at the lowest ordinal, optionally only among rows that satisfy ``where``."""
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, order if where is None else F.when(where, order))
