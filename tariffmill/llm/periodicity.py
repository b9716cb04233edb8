"""Runs of repeated word sequences, by uniting suffix classes in the order of descending common prefixes.

A run is a stretch of words with smallest period q and a length of at least max(12, 2 q) that no neighbour extends. The
suffixes of a text are sorted by doubling, and the common prefixes of neighbours in that order are the edges of a path.
Kruskal's rule takes the edges from the longest prefix down and unites the classes at both ends; a class holds the ordered
positions of its suffixes, and the smaller one is put into the larger. When an edge of prefix l makes two positions of
different classes neighbours in their union, their common prefix is exactly l, so where they are d <= l apart, a square
stands there: the seed of a run of period d, which begins there if the words before them differ. The two positions that
begin a run are one smallest period apart, no position between them shares so long a prefix, and so every run is seeded;
seeds with a multiple of the period give the same stretch and the least period counts.

A run of the wanted length has a common prefix of at least ``least - least // 2`` words between its first two periods,
so only texts in which some sequence of that many words occurs twice are sorted at all, and edges below it are left out.

Each text is a row of its own and is read whole; memory is bounded by the longest text (some 150 bytes a word). Defined
cases: words are runs of other than the six ASCII blanks; null, empty and blank texts have no words and no runs and
collapse to the empty text; repeated rows have equal results; ids are not looked at. Of runs of equal length the first
start and then the least period is the longest. Other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffmill.llm.common import free_name

LEAST = 12
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as integers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def has_repeat(words: np.ndarray, size: int) -> bool:
    """Whether any ``size`` words in sequence may occur twice: equal hashes, so never a wrong no."""
    if len(words) <= size:
        return False
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    own = (words.astype(np.uint64) + np.uint64(1)) * MIX
    own ^= own >> np.uint64(29)
    for k in range(size):
        rolled = (rolled ^ own[k:len(words) - size + 1 + k]) * MIX
        rolled ^= rolled >> np.uint64(31)
    rolled.sort()
    return bool((rolled[1:] == rolled[:-1]).any())


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the next one."""
    n = len(words)
    ranks, size = [words.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        second = np.full(n, -1, np.int64)
        second[:max(n - size, 0)] = rank[size:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        size *= 2
        if fresh.sum() == n - 1:
            break
        ranks.append(rank)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # A rank tells equal stretches of 2 ** level words apart from others only where both stretches end inside the text.
        inside = np.maximum(left, right) + (1 << level) <= n
        at = np.flatnonzero(inside)
        same = at[ranks[level][left[at]] == ranks[level][right[at]]]
        common[same] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, common


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    shared = least - least // 2
    if not has_repeat(words, shared):
        return []
    order, common = sorted_suffixes(words)
    edges = np.flatnonzero(common >= shared)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    before = np.concatenate([[-1], words[:-1]]).tolist()
    place, prefix = order.tolist(), common[edges].tolist()
    members: dict[int, list[int]] = {}
    parent = {}

    def find(at: int) -> int:
        root = at
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[at] != root:
            parent[at], at = root, parent[at]
        return root

    seeds: dict[tuple[int, int], int] = {}

    def seed(low: int, high: int, length: int) -> None:
        period = high - low
        if period <= length and length + period >= least and (before[low] != before[high] or not low):
            stretch = low, length + period
            seeds[stretch] = min(period, seeds.get(stretch, period))

    for edge, length in zip(edges.tolist(), prefix):
        one, other = find(edge), find(edge + 1)
        large, small = (members.pop(root, None) or [place[root]] for root in (one, other))
        if len(large) < len(small):
            large, small, one, other = small, large, other, one
        parent[other] = one
        members[one] = large
        added = None
        for position in small:
            at = bisect_left(large, position)
            if at and large[at - 1] != added:
                seed(large[at - 1], position, length)
            if at < len(large):
                seed(position, large[at], length)
            large.insert(at, position)
            added = position
    return sorted((start, length, period) for (start, length), period in seeds.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when each run keeps its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    gone = np.cumsum(depth) > 0
    return b" ".join(w for w, drop in zip(words, gone) if not drop)


def _rows(least: int, names: list[str], text_name: str, key_name: str | None, prepare: Callable[[object, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            found, texts = [], []
            keys = batch.column(key_name).to_pylist() if key_name else [None] * batch.num_rows
            for key, text in zip(keys, batch.column(text_name)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if prepare is not None:
                    words = prepare(key, words)
                runs = find_runs(numbered(words), least)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, kind), pa.array(texts, pa.string())], [*names, "found", "left"])

    return run


def periodic_runs(
    docs: DataFrame, least: int = LEAST, text_column: str = "text", key_column: str | None = None,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, runs_as: str = "runs", text_as: str = "collapsed_text",
) -> DataFrame:
    """``docs`` with every run of each text and the text in which each run keeps its first period.

    ``prepare(key, words)`` may change a text's words first; ``key`` is the row's ``key_column``. The new columns replace
    columns of the same names.
    """
    kept = [c for c in docs.columns if c.lower() not in (runs_as.lower(), text_as.lower())]
    helper = free_name(docs, "read_text", "read_key")
    inner = {c: f"c{k}" for k, c in enumerate(kept)}
    source = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()], F.col(text_column).cast("string").alias(helper["read_text"]),
                         *([F.col(key_column).alias(helper["read_key"])] if key_column else []))
    schema = T.StructType([*source.select(*inner.values()).schema, T.StructField("found", RUNS), T.StructField("left", T.StringType())])
    done = source.mapInArrow(
        _rows(least, list(inner.values()), helper["read_text"], helper["read_key"] if key_column else None, prepare), schema)
    return done.select(*[F.col(a).alias(c) for c, a in inner.items()], F.col("found").alias(runs_as), F.col("left").alias(text_as))


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The rule of the query's contract that makes every tenth text periodic from some word on; a null id changes nothing."""
    from zlib import crc32

    n = len(words)
    if key is None or not n:
        return words
    h = crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def summary(found: DataFrame) -> DataFrame:
    """The contract's columns from ``runs`` and ``collapsed_text``."""
    longest = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(
        x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])), "\n")
    some = F.size("runs") > 0
    return found.withColumn("top", F.when(some, longest)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
