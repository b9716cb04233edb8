"""Byte-level BPE with a rank queue on a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair that is a token of the vocabulary puts its left position into
the bucket of its rank; a two-level bitmap marks the buckets that hold something. Find-first-set on the upper and then on
the lower level gives the least rank, the bucket its leftmost position. A merge changes two pairs at most, whose new
ranks are queued; entries whose pair has since changed are stale and skipped. A step costs the same however long the
pre-token is, so a text without blanks of a million bytes is no special case.

Short pre-tokens share one such queue: thousands of them lie behind each other in one linked list, and a step takes one
rank, the least that any of them waits for, and merges in each its leftmost pair of that rank by array operations. The
order within each pre-token is the same. A long one has a queue of its own, which costs less a step.

Pre-tokens recur, so a worker keeps their ids between tasks, up to ``CACHE_ENTRIES``; a full cache starts anew. Batches are worked on and returned in parts of ``PART_BYTES``, so that a
worker holds one part or one text. The vocabulary file is read once on the driver and broadcast; a check of its size
bounds the broadcast.

Defined cases: a null or empty text has no tokens; ids may be null or repeat; equal pairs are merged from the left; a
very long text or pre-token is one value in one task; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

GROUP = 8  # bits of a rank that choose its place in a word of the lower level
MASK = (1 << GROUP) - 1
CACHE_ENTRIES = 300_000
SHORT = 128  # bytes of a pre-token up to which it shares a queue
QUEUE_BYTES = 1_000_000
PART_BYTES = 4 * 2**20
LARGEST_FILE = 64 * 2**20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of lines "base64 rank"."""
    if os.path.getsize(path) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes, the bound for what is broadcast")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the leftmost pair of the least rank is merged."""
    whole = ranks.get(token)
    if whole is not None:
        return [whole]
    size = len(token)
    get = ranks.get
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    pair = [get(token[at:at + 2], -1) for at in range(size - 1)]  # rank of the pair that starts here; -1: none, or merged away
    pair.append(-1)
    waiting = [(rank, at) for at, rank in enumerate(pair) if rank >= 0]  # to be queued before the next pick
    buckets: dict[int, list[int]] = {}
    upper, lower = 0, {}
    while True:
        for rank, at in waiting:
            if rank in buckets:
                heappush(buckets[rank], at)
                continue
            buckets[rank] = [at]
            word = rank >> GROUP
            if word in lower:
                lower[word] |= 1 << (rank & MASK)
            else:
                lower[word] = 1 << (rank & MASK)
                upper |= 1 << word
        waiting.clear()
        if not upper:
            break
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        rank = word << GROUP | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                lower[word] = bits
            else:
                del lower[word]
                upper &= upper - 1
        if pair[at] != rank:
            continue
        gone = after[at]
        right = after[at] = after[gone]
        pair[gone] = pair[at] = -1
        if right < size:
            before[right] = at
            found = get(token[at:after[right]])
            if found is not None:
                pair[at] = found
                waiting.append((found, at))
        left = before[at]
        if left >= 0:
            found = get(token[left:right])
            if found is None:
                pair[left] = -1
            else:
                pair[left] = found
                waiting.append((found, left))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[token[at:after[at]]])
        at = after[at]
    return ids


class Pairs:
    """Rank of two adjacent tokens, for arrays of them: a sorted list of all splits of tokens into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray | int, right: np.ndarray) -> np.ndarray:
        """-1 where the two are no token."""
        keys = left << 32 | right
        at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


def merge_together(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Packed ids of many pre-tokens that lie behind each other in one linked list and wait in one queue."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ids = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    count = len(ids)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(pieces)), sizes)
    after, before = np.arange(1, count + 1), np.arange(-1, count - 1)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    pair = np.full(count, -1, np.int64)
    linked = np.flatnonzero(after >= 0)
    pair[linked] = pairs.of(ids[linked], ids[linked + 1])
    alive = np.ones(count, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    upper, lower = 0, {}
    waiting = np.flatnonzero(pair >= 0)  # to be queued before the next pick
    while True:
        if len(waiting):
            found = pair[waiting]
            order = found.argsort(kind="stable")
            found, waiting = found[order], waiting[order]
            starts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist()]
            for rank, start, stop in zip(found[starts].tolist(), starts, [*starts[1:], len(found)]):
                if rank in buckets:
                    buckets[rank].append(waiting[start:stop])
                    continue
                buckets[rank] = [waiting[start:stop]]
                word = rank >> GROUP
                if word in lower:
                    lower[word] |= 1 << (rank & MASK)
                else:
                    lower[word] = 1 << (rank & MASK)
                    upper |= 1 << word
        if not upper:
            break
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        rank = word << GROUP | (bits & -bits).bit_length() - 1
        parts = buckets.pop(rank)
        places = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = places[pair[places] == rank]
        owner = own[at]
        again = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        if len(again):  # a pre-token merges its leftmost pair only; the merge may make a pair of a lesser rank
            buckets[rank] = [at[again]]
            at = np.delete(at, again)
        else:
            bits &= bits - 1
            if bits:
                lower[word] = bits
            else:
                del lower[word]
                upper &= upper - 1
        gone = after[at]
        right = after[gone]
        ids[at], after[at], pair[gone], alive[gone], pair[at] = rank, right, -1, False, -1
        follows = right >= 0
        if not follows.all():
            right, ahead = right[follows], at[follows]
        else:
            ahead = at
        before[right] = ahead
        pair[ahead] = pairs.of(rank, ids[right])
        left = before[at]
        left = left[left >= 0]
        pair[left] = pairs.of(ids[left], rank)
        waiting = np.concatenate([ahead, left])
        waiting = waiting[pair[waiting] >= 0]
        waiting.sort()
    kept = ids[alive].astype("<u4").tobytes()
    stops = (np.concatenate([[0], np.cumsum(alive)])[ends] * 4).tolist()
    return [kept[a:b] for a, b in zip([0, *stops], stops)]


class Encoder(dict):
    """Pre-token -> its ids, packed. A dictionary, so that texts are joined without a Python step a known pre-token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks)
        return pack(f"<{len(ids)}I", *ids)

    def learn(self, pieces: Iterable[str]) -> None:
        """Fill the cache with those of ``pieces`` that share a queue; longer ones are merged where they stand."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        waiting, held = [], 0
        for piece in pieces:
            if piece in self:
                continue
            token = piece.encode()
            if token in self.ranks:
                self[piece] = self.ranks[token].to_bytes(4, "little")
            elif len(token) <= SHORT:
                waiting.append((piece, token))
                held += len(token)
                if held > QUEUE_BYTES:
                    self._merge(waiting)
                    waiting, held = [], 0
        if waiting:
            self._merge(waiting)

    def _merge(self, waiting: list[tuple[str, bytes]]) -> None:
        self.update(zip([p for p, _ in waiting], merge_together([t for _, t in waiting], self.pairs)))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t or "") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _in_parts(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``PART_BYTES`` together, or one row."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > PART_BYTES:
            yield start, at
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes)


def _encoder(shared) -> Encoder:
    """The worker's encoder: it lives in the broadcast value, which a worker process keeps between tasks."""
    state = shared.value
    if "encoder" not in state:
        state["encoder"] = Encoder(state["ranks"], state["pattern"])
    return state["encoder"]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start, stop in _in_parts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                part = batch.slice(start, stop - start)
                packed = encoder.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start, stop in _in_parts(pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_pylist()):
                part = batch.slice(start, stop - start)
                texts = [encoder.decode(p.as_py() or b"") for p in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return run


class Tokenizer:
    """Encodes and decodes columns with one vocabulary."""

    def __init__(self, spark, path: str, pattern: str):
        self.shared = spark.sparkContext.broadcast({"ranks": load_ranks(path), "pattern": pattern})

    def encode(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, ids (unsigned 32-bit integers, little-endian) of each whole ``text``. No exchange."""
        texts = docs.select("doc_id", "text")
        id_type = texts.schema[0].dataType.simpleString()
        return texts.mapInArrow(_encode(self.shared), f"doc_id {id_type}, n_tokens long, ids binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``encoded`` with ``decoded``, the bytes that its ``ids`` stand for."""
        columns = encoded.drop("decoded")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)
        return columns.mapInArrow(_decode(self.shared), f"{fields}, decoded binary")
