"""Variable-capacity best-fit packing.

Lengths are bounded by the largest permitted capacity, so the whole corpus is described by one count a length. Packing
is planned on that histogram: lengths are taken in falling order and put into the open bins that they fill best, many
equal bins at a time; where none fits, bins of the least-cost size are opened. A plan is made for every choice of
permitted opening sizes, each bin is then downsized to the smallest capacity that holds its contents, and the plan with
the least total cost is taken. The plan's size depends on the capacities, not on the corpus.

Pieces meet the plan by their rank among pieces of their length. Ranks are counted in blocks: a length with a third of
all pieces is numbered in parallel, each block from its own offset.

A document's length is its number of words (runs of other than six ASCII blanks) plus one for a separator. Documents
longer than the largest capacity are cut into full pieces and a rest. Defined cases: a null or empty text is a piece of
length 1; equal rows are separate pieces; null ids are kept; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import Workspace, text_hash

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 16  # what a bin costs besides its capacity
BLOCK_ROWS = 100_000


@dataclass
class Plan:
    """Segments in order of (length, first rank): ``many`` of a length in each of some equal bins of one pattern."""

    length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    bin: np.ndarray
    start: np.ndarray
    capacity: np.ndarray
    cost: int
    bins: int


def fitted(size: int, capacities: Sequence[int]) -> int:
    return capacities[bisect_left(capacities, size)]


def _open_size(length: int, sizes: Sequence[int], histogram_mean: float, bin_cost: int) -> int:
    """The opening size of the least cost a token if the bin is filled up with pieces of the mean remaining length."""
    def price(size: int) -> float:
        spare = size - length
        return (size + bin_cost) / (length + (spare // max(1.0, histogram_mean)) * histogram_mean)

    return min((s for s in sizes if s >= length), key=lambda s: (price(s), s))


def best_fit(histogram: dict[int, int], capacities: Sequence[int], sizes: Sequence[int], bin_cost: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (bins, {length: pieces in each}). ``sizes``: what may be opened; the largest is always a capacity."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, holds: dict[int, int]) -> None:
        if room not in by_room:
            insort(rooms, room)
        by_room.setdefault(room, []).append((bins, holds))

    def take(room: int) -> tuple[int, dict[int, int]]:
        found = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.pop(bisect_left(rooms, room))
        return found

    left_pieces, left_total = sum(histogram.values()), sum(k * v for k, v in histogram.items())
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        mean = left_total / left_pieces
        while count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, holds = take(room)
            else:
                room = _open_size(length, sizes, mean, bin_cost)
                bins, holds = -(-count // (room // length)), {}
            each = min(room // length, count)
            used = min(bins, count // each)
            if used < bins:
                put(room, bins - used, holds)
            put(room - each * length, used, {**holds, length: each})
            count -= used * each
        left_pieces -= histogram[length]
        left_total -= length * histogram[length]
    return [(bins, holds) for room in by_room for bins, holds in by_room[room] if holds]


def make_plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> Plan:
    capacities = sorted(capacities)
    def sized(pattern: tuple[int, dict[int, int]]) -> int:
        return fitted(sum(k * v for k, v in pattern[1].items()), capacities)

    best, best_cost = [], None
    choices = [capacities[i:j] for j in range(1, len(capacities) + 1) for i in range(j) if not histogram or capacities[j - 1] >= max(histogram)]
    for sizes in choices:
        patterns = best_fit(histogram, capacities, sizes, bin_cost)
        cost = sum(bins * (sized((bins, holds)) + bin_cost) for bins, holds in patterns)
        if best_cost is None or cost < best_cost:
            best, best_cost = patterns, cost
    best.sort(key=lambda p: sorted(p[1].items(), reverse=True), reverse=True)
    rows, next_bin, ranks = [], 0, dict.fromkeys(histogram, 0)
    for bins, holds in best:
        start, capacity = 0, sized((bins, holds))
        for length in sorted(holds, reverse=True):
            rows.append((length, ranks[length], holds[length], next_bin, start, capacity))
            ranks[length] += bins * holds[length]
            start += length * holds[length]
        next_bin += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(*columns, cost=best_cost or 0, bins=next_bin)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pa.array([len((t.as_py() or "").encode().split()) + 1 for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), size], ["doc_id", "text_hash", "n_tokens"])


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, many, bins, starts, capacity = plan.value
        span = int(first.max(initial=0)) + 1
        bounds = np.searchsorted(lengths, np.arange(int(lengths.max(initial=0)) + 2))
        key = lengths * span + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.minimum(np.searchsorted(key, length * span + np.minimum(rank, span - 1), "right") - 1, bounds[length + 1] - 1)
            ahead = rank - first[at]
            columns = {
                "bin": bins[at] + ahead // many[at], "capacity": capacity[at], "bin_start": starts[at] + (ahead % many[at]) * length,
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), batch.column("length"), *(pa.array(v) for v in columns.values())],
                ["doc_id", "piece", "start", "length", *columns],
            )

    return run


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> DataFrame:
    """A row a piece: doc_id, piece, start (first token of the document in it), length, bin, capacity, bin_start.

    The driver sees one count for each length up to the largest capacity and for each block of ranks; the broadcast plan
    is bounded by the capacities too.
    """
    spark, largest = docs.sparkSession, max(capacities)
    work = Workspace(spark, "packing")
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    sized = docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(
        _lengths, f"doc_id {id_type}, text_hash long, n_tokens long"
    )
    cut = sized.select("doc_id", "text_hash", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {largest}"))).alias("piece"))
    pieces = work.save(cut.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * largest).cast("long").alias("start"),
        F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).cast("long").alias("length"),
        F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(2 ** 31)).alias("draw"),
    ), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, capacities, bin_cost)
    plan = spark.sparkContext.broadcast((plan.length, plan.first, plan.many, plan.bin, plan.start, plan.capacity))

    blocks = spark.createDataFrame(
        [(k, -(-v // BLOCK_ROWS)) for k, v in histogram.items()], "length long, blocks long"
    )
    # As many rows as there are lengths, so at most the largest capacity; pieces so stay where they are until their blocks are known.
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.expr("draw % blocks"))
    from pyspark.sql import Window
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = work.save(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
    inside = Window.partitionBy("length", "block").orderBy("draw", "doc_id", "piece")
    ranked = dealt.withColumn("place", F.row_number().over(inside)).join(offsets, ["length", "block"]).select(
        "doc_id", "piece", "start", "length", (F.col("offset") + F.col("place") - 1).alias("rank")
    )
    return ranked.mapInArrow(_placed(plan), f"doc_id {id_type}, piece int, start long, length long, bin long, capacity long, bin_start long")
