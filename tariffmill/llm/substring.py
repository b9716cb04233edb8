"""Removal of passages that repeat, by seeds and extension.

Seeds: of any ``min_words`` consecutive words, winnowing picks one anchor, the least hash among its ``ANCHOR``-word runs
(leftmost on ties). The choice depends on these words alone, so two equal windows pick the same anchor at the same place,
and every repeat of ``min_words`` words or more shows as an anchor that documents share. Extension: each anchor carries a
hash of its reach, the words from the first to the last window that picked it, to both sides at once. Equal reaches mean
that all these windows repeat. Where one anchor has several reaches, its matches end inside them; one occurrence of each
such reach is then extended window by window, and windows are counted over all reaches of the anchor. Windows found this
way are merged to maximal repeats.

Anchors are counted by aggregates and joined by hash, never paired: a passage in n documents costs n rows. Equality rests
on the anchor's and the reach's (or window's) 64-bit hashes together.

Defined cases: words are runs of other than the six ASCII blanks; a null text has none; texts of fewer than ``min_words``
words lose nothing. Repeated rows are occurrences like any others. Ids may be null or repeat. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import Workspace, same_row, text_hash
from tariffmill.llm.minhash import mix, word_hashes

ANCHOR = 8
BLOCK = 8192
LOW = 10  # bits of each of the two distances that share a long with a word's place
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)
WINDOW = "start int, stop int"


class RangeHash:
    """64-bit hash of any run of a text's words from sums of hash * BASE**place."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, hashes: np.ndarray):
        while len(self._powers[0]) <= len(hashes):
            RangeHash._powers = tuple(
                np.concatenate([p, p * np.uint64(pow(x, len(p), 2**64))]) for p, x in zip(self._powers, (BASE, INVERSE))
            )
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._powers[0][:len(hashes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self._powers[1][start] + (stop - start).astype(np.uint64))


def anchors(hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, reach hash, place of the first window, distances of anchor and last window from it."""
    count = len(hashes) - min_words + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 3
    run = min(ANCHOR, min_words)
    ranges = RangeHash(hashes)
    places = np.arange(len(hashes) - run + 1)
    grams = ranges.of(places, places + run)
    width = min_words - run + 1
    picked = np.empty(count, np.int64)
    for start in range(0, count, BLOCK):
        stop = min(start + BLOCK, count)
        views = np.lib.stride_tricks.sliding_window_view(grams[start:stop + width - 1], width)
        picked[start:stop] = views.argmin(axis=1) + np.arange(start, stop)
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    last = np.concatenate([first[1:], [count]]) - 1
    at = picked[first]
    shape = ((at - first) << LOW) | (last - first)
    reach = mix(ranges.of(first, last + min_words) ^ mix(shape.astype(np.uint64)))
    return grams[at].view(np.int64), reach.view(np.int64), (first << (2 * LOW)) | shape


def _seeds(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(word_hashes(t.as_py(), False), min_words) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(f[0]) for f in found)])
            parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(p, pa.int64()) for p in parts], ["anchor", "reach", "place"]
            ))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), listed], ["row", "doc_id", "text_hash", "seeds"]
            )

    return run


def _windows(min_words: int):
    """Every window of the reaches asked for: anchor, reach, copies, offset of the anchor in the window, window hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "reach", "copies", "offset", "window"]
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                ranges = RangeHash(word_hashes(text.as_py(), False))
                flat = asked.values
                anchor, reach, copies, place = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "reach", "copies", "place"))
                first, at, size = place >> (2 * LOW), (place >> LOW) & (2 ** LOW - 1), (place & (2 ** LOW - 1)) + 1
                which = np.repeat(np.arange(len(place)), size)
                step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                start = first[which] + step
                values = (anchor[which], reach[which], copies[which], at[which] - step, ranges.of(start, start + min_words).view(np.int64))
                for column, value in zip(columns, values):
                    column.append(value)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n_words", "n_removed", "repeats", "kept_text"]
    kinds = [None, None, pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string()]
    for batch in batches:
        out: list[list] = [[] for _ in names[2:]]
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            found = (text.as_py() or "").encode().split()
            whole = merged([(s["start"], s["stop"]) for s in spans.as_py() or []])
            keep, at = [], 0
            for start, stop in whole:
                keep += found[at:start]
                at = stop
            keep += found[at:]
            for column, value in zip(out, (len(found), len(found) - len(keep), [{"start": a, "stop": b} for a, b in whole], b" ".join(keep).decode())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, k) for c, k in zip(out, kinds[2:]))], names
        )


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_words, n_removed, repeats (maximal, merged), kept_text.

    A word goes when it lies in a window of ``min_words`` words whose words also start anywhere else, the same document
    included. All occurrences go, so the result does not depend on the order of the documents.
    """
    if not 1 <= min_words < 2 ** LOW:
        raise ValueError(f"min_words must be from 1 to {2 ** LOW - 1}")
    work = Workspace(docs.sparkSession, "substring")
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    texts = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    listed = work.save(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _seeds(min_words), f"row long, doc_id {id_type}, text_hash long, seeds array<struct<anchor:long,reach:long,place:long>>"
    ), "seeds")
    all_seeds = listed.select("row", F.inline("seeds"))
    # Counts are written before they are met, so that the joins have plain exchanges on both sides and a hot anchor is split.
    shared = work.save(all_seeds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")
    ).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    work.release()
    seeds = work.save(all_seeds.join(shared, "anchor"), "shared")
    work.release()

    ends = work.save(seeds.where("mixed").groupBy("anchor", "reach").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "place")).alias("of")
    ), "ends")
    asked = ends.groupBy(F.col("of.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "reach", "copies", F.col("of.place").alias("place"))).alias("asked")
    ).join(listed.select("row", "doc_id", "text_hash"), "row")
    windows = work.save(asked.join(texts, same_row(asked, texts)).select("text", "asked").mapInArrow(
        _windows(min_words), "anchor long, reach long, copies long, offset long, window long"
    ).distinct(), "windows")
    work.release()
    again = windows.groupBy("anchor", "offset", "window").agg(F.sum("copies").alias("n")).where("n > 1")
    partly = work.save(
        windows.join(again, ["anchor", "offset", "window"]).groupBy("anchor", "reach").agg(F.collect_list("offset").alias("offsets")), "partly"
    )
    first = F.shiftright("place", 2 * LOW)
    at, size = F.shiftright("place", LOW).bitwiseAND(F.lit(2 ** LOW - 1)), F.col("place").bitwiseAND(F.lit(2 ** LOW - 1))
    whole = seeds.where("NOT mixed").select("row", first.cast("int").alias("start"), (first + size + min_words).cast("int").alias("stop"))
    begin = (first + at - F.col("offset")).cast("int")
    parts = seeds.where("mixed").join(partly, ["anchor", "reach"]).select("row", "place", F.explode("offsets").alias("offset")).select(
        "row", begin.alias("start"), (begin + min_words).alias("stop")
    )
    spans = whole.union(parts).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    by_text = work.save(spans.join(listed.select("row", "doc_id", "text_hash"), "row").groupBy("doc_id", "text_hash").agg(
        F.first("spans").alias("spans")), "spans")
    work.drop("anchors", "shared", "ends", "windows", "partly", "seeds")
    met = texts.join(by_text, same_row(texts, by_text), "left").select(texts["doc_id"], texts["text_hash"], "text", "spans")
    return met.mapInArrow(
        _cut, f"doc_id {id_type}, text_hash long, n_words long, n_removed long, repeats array<struct<start:int,stop:int>>, kept_text string"
    )


def filter_documents(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All documents, without their repeated passages, in the columns of ``docs``; untouched texts keep their blanks."""
    cut = repeats(docs, min_words).where("n_removed > 0").select("doc_id", "text_hash", "kept_text").distinct()
    inner = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names that meet none of the other side
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], text_hash().alias("own_hash"))
    met = keyed.join(cut, keyed[inner["doc_id"]].eqNullSafe(cut["doc_id"]) & (keyed["own_hash"] == cut["text_hash"]), "left")
    text = F.coalesce(cut["kept_text"], keyed[inner["text"]])
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return met.select(*[new.get(c, keyed[n]).alias(c) for c, n in inner.items()])


ORACLE = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
win AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS seen
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY seen) AS c FROM win) WHERE c >= 2),
lost AS (SELECT doc_id, list_sort(list(DISTINCT i + k)) AS places FROM again CROSS JOIN (SELECT unnest(range(0, 35)) AS k) GROUP BY ALL),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM (
        SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
    ) u WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(places) AS pos FROM lost) l WHERE l.doc_id = u.doc_id AND l.pos = u.pos) GROUP BY ALL
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
