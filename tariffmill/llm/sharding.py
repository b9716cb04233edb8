"""Sharding by histogram sort.

Rows are ordered by a 64-bit key: the CRC-32 of the text above 32 bits hashed from the id, so that equal texts lie next to
each other and a group of any size can still be cut. Splitters are found by probing: each round counts, exactly and over
all partitions at once, the bytes below a few candidate boundaries in every splitter's open interval, and narrows it,
until the bytes below each splitter are within ``tolerance`` of their share or no row lies between two probes. Only the
boundaries of shards are probed, so at most 2**PROBE_BITS counts a shard and round reach the driver, whatever the corpus.
A splitter leaves the edges of a CRC only inside a group of equal texts that is larger than the tolerance.

Then rows are exchanged once, to ranges much smaller than a shard. A range is an interval of keys of equal width in one
shard; a CRC that alone exceeds ``range_bytes`` is cut further by the hashed id. Ranges are counted, summed up and joined
as tables and never listed on the driver. Rows are sorted in their range and numbered from the counts of those before.

Law ``bytes``: sizes of shards are as equal as the tolerance and single rows permit. A row's size is its text's length
in UTF-8 plus 8. Defined cases: a null text has size 8; rows of equal key are neighbours in one range; null ids hash
like any value; ties in key and id are numbered in any order; a very long text is one row of its size and is never cut;
no rows give no rows; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffmill.llm.common import Workspace, text_or_empty

LAW = "bytes"
PROBE_BITS = 8
RANGE_BYTES = 32 * 2**20
RANGES_PER_TASK = 4
LOW, HIGH = -(2**63), 2**63 - 1


def row_size() -> Column:
    return (F.octet_length(text_or_empty()) + 8).cast("long")


def row_crc() -> Column:
    return F.crc32(F.encode(text_or_empty(), "UTF-8"))


def row_key() -> Column:
    return F.shiftleft(row_crc() - 2**31, 32).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(2**32 - 1)))


def reached(bounds: list[int]):
    """Arrow function of a long column: how many of the sorted ``bounds``, one a shard, are at most its value."""
    values = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def found(column: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(values, column.to_numpy(), "right"))

    return found


@dataclass
class Splitter:
    """One boundary: its target lies between the bytes below ``low`` and those below ``low + 2**bits``."""

    target: float
    low: int = LOW
    bits: int = 64
    below: int = 0
    inside: int = 0

    def best(self) -> int:
        return self.low if self.target - self.below <= self.below + self.inside - self.target else min(self.low + 2**self.bits, HIGH)


def split_points(keys: DataFrame, parts: int, tolerance: float) -> list[int]:
    """Keys at which ``parts`` ranges of near equal bytes start; the first, which starts at the least key, is left out.

    A round probes 2**PROBE_BITS - 1 boundaries in each open interval with one aggregate over the keys in open intervals.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    allowed = tolerance * total / parts
    splitters = [Splitter(total * k / parts, inside=total) for k in range(1, parts)]
    waiting, bits = (splitters if total else []), 64
    while waiting and bits:
        near = keys
        if bits < 64:
            open_intervals = keys.sparkSession.createDataFrame([(x,) for x in {s.low >> bits for s in waiting}], "interval long")
            near = keys.join(open_intervals, F.shiftright("key", bits) == F.col("interval"), "left_semi")
        finer = bits - PROBE_BITS
        counted = near.groupBy(F.shiftright("key", finer).alias("probe")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        found = defaultdict(list)
        for r in sorted(counted.collect(), key=lambda r: r["probe"]):
            found[r["probe"] << finer >> bits if bits < 64 else LOW >> bits].append((r["probe"], r["n"], r["bytes"]))
        sums = {k: np.cumsum([b for _, _, b in v]) for k, v in found.items()}
        still = []
        for s in waiting:
            probes, reached = found[s.low >> bits], sums[s.low >> bits]
            at = min(int(np.searchsorted(reached, s.target - s.below)), len(probes) - 1)
            probe, rows, s.inside = probes[at]
            s.below, s.low, s.bits = s.below + int(reached[at]) - s.inside, probe << finer, finer
            if min(s.target - s.below, s.below + s.inside - s.target) > allowed and rows > 1:
                still.append(s)
        waiting, bits = still, finer
    return sorted(s.best() for s in splitters)


def interval(key: Column, bits: int) -> Column:
    """Number of the key's interval among 2**``bits`` of equal width."""
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")


def group_of(key: Column) -> Column:
    """The CRC inside a key."""
    return F.shiftright(key, 32)


def heavy_crc() -> Column:
    """``crc`` after the left join with heavy ones; all other rows get one number below every CRC."""
    return F.coalesce("crc", F.lit(-(2**32)))


def cut_of(key: Column) -> Column:
    """Number of a row's cut in a CRC with 2**``cut_bits`` cuts; rows of other CRCs have none and come first."""
    low = key.bitwiseAND(F.lit(2**32 - 1))
    return F.when(F.col("cut_bits").isNull(), F.lit(-1)).otherwise(F.floor(low / F.pow(F.lit(2.0), 32 - F.col("cut_bits")))).cast("long")


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot (from 0 in each shard) and grown_shard (null).

    Slots follow the key; inside a key interval, CRCs larger than ``range_bytes`` come last. A range holds rows of one shard
    only, and a task some ranges, so that the exchange and the sort have as many tasks as the data need.
    """
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    plain = docs.drop(*results)
    work = Workspace(docs.sparkSession, "sharding")
    keys = work.save(docs.select(row_key().alias("key"), row_size().alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    home = reached(split_points(keys, shards, tolerance))
    bits = min(32, max(0, -(-total // range_bytes) - 1).bit_length())

    wide = keys.groupBy(interval(F.col("key"), bits).alias("in")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > range_bytes).select("in")
    heavy = work.save(
        keys.join(wide, interval(F.col("key"), bits) == F.col("in"), "left_semi").groupBy(group_of(F.col("key")).alias("crc")).agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > range_bytes).select("crc", F.least(F.lit(32), F.ceil(F.log2(F.col("bytes") / range_bytes))).cast("int").alias("cut_bits")), "heavy",
    )
    # With the shard and the interval, a heavy row's CRC and cut name its range.
    place = ["home", "part", "crc", "cut"]
    sized = keys.join(heavy, group_of(F.col("key")) == F.col("crc"), "left").select(
        home("key").alias("home"), interval(F.col("key"), bits).alias("part"), heavy_crc().alias("crc"), cut_of(F.col("key")).alias("cut")
    ).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("home").orderBy("part", "crc", "cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.save(sized.select(*place, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")), "starts")

    inner = {c: f"c{k}" for k, c in enumerate(plain.columns)}  # names that meet no helper's
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], row_key().alias("key"), row_size().alias("size"), row_crc().cast("long").alias("text_crc32"))
    placed = keyed.join(heavy, group_of(F.col("key")) == F.col("crc"), "left").withColumns({
        "home": home("key"), "part": interval(F.col("key"), bits), "crc": heavy_crc(), "cut": cut_of(F.col("key")),
    }).drop("cut_bits")
    tasks = max(shards, -(-total // (RANGES_PER_TASK * range_bytes)))
    order = Window.partitionBy(place).orderBy("key", inner["doc_id"])
    numbered = placed.repartition(tasks, *place).withColumn("at", F.row_number().over(order))
    met = numbered.join(starts, place)
    return met.select(
        *[F.col(n).alias(c) for c, n in inner.items()], "size", "text_crc32", F.lit(LAW).alias("law"), F.col("home").alias("shard"),
        (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
