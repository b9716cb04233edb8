"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two signature values, its minimum and its maximum, so
``2 * permutations`` values cost half the evaluations; both agree between two sets with probability equal to their
Jaccard similarity. The values are banded; texts that share a band are candidates, and every link is confirmed on the
full shingle sets.

Texts with equal sets are one node from the start, so copies never meet each other in pairs. In a bucket of a band all
nodes are first compared with the smallest one, a pair a node. Where a bucket still holds several components, its nodes
outside the largest of them are a query set that is compared with all of its nodes, in blocks of ``BLOCK_ROWS`` by
``BLOCK_ROWS`` sets whose links alone leave the task. Then any two nodes of a bucket are in one component or were
compared, and no link that the bands show is lost. With 5 values a band and 32 bands a pair of similarity 0.8 is missed
with probability 3e-6.

Defined cases: words are runs of other than the six ASCII blanks after A-Z became a-z; a text with fewer words than a
shingle is one shingle; without words the set is empty and linked with nothing, so each such row is a component of its
own. Repeated rows have equal sets. Ids may be null: they count as larger than others in the choice of component_id,
which is null only if no id of the component is not. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffmill.llm.common import Workspace, same_row, text_hash
from tariffmill.llm.exact_dedup import located
from tariffmill.llm.graph import components

BAND_VALUES = 5
BANDS = 32
BLOCK = 4096
BLOCK_ROWS = 256
PERCENT = 80
#: Bits of the map of wanted texts: 2 MB, of which a bitmap function of Spark fills 4,096 bytes at a time.
WANTED_BITS, BUCKET_BYTES = 2**24, 4096
WORD_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, lower: bool) -> np.ndarray:
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass")
    found = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words each; of all words if there are fewer."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    rolled = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = mix(rolled * WORD_MIX + hashes[k:len(hashes) - size + 1 + k])
    return np.unique(rolled)


def permutations(bands: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    count = bands * values // 2
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * WORD_MIX)
    return seeds[:count] | np.uint64(1), seeds[count:]


def band_hashes(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray, bands: int) -> np.ndarray:
    """Half of the bands hold minima, the other half maxima. Blocks bound the memory of a very long text."""
    low, high = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(factor), np.uint64)
    for start in range(0, len(shingles), BLOCK):
        drawn = shingles[start:start + BLOCK, None] * factor + shift
        np.minimum(low, drawn.min(axis=0), out=low)
        np.maximum(high, drawn.max(axis=0), out=high)
    rows = np.concatenate([low, high]).reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out * WORD_MIX + rows[:, k])
    return out.view(np.int64)


def _signatures(size: int, bands: int, values: int, least: int, names: list[str]):
    factor, shift = permutations(bands, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            digests, counts, banded = [], [], []
            for text in batch.column("text"):
                own = shingle_set(word_hashes(text.as_py(), True), size)
                digests.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                counts.append(len(own))
                banded.append(band_hashes(own, factor, shift, bands) if len(own) >= least else None)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
                pa.array(banded, pa.list_(pa.int64())),
            ], [*names, "digest", "n_shingles", "bands"])

    return run


def _sets(size: int, wanted: bytes):
    """Shingle sets of the rows whose text hash has its bit set; a bit may be set by another text, never missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            at = batch.column("bit").to_numpy()
            picked = batch.take(pa.array(np.flatnonzero(filled[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            sets = [shingle_set(word_hashes(t.as_py(), True), size).tobytes() for t in picked.column("text")]
            yield pa.RecordBatch.from_arrays(
                [picked.column("doc_id"), picked.column("text_hash"), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "shingles"])

    return run


def _wanted_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted rows. Texts that surely are not wanted stay where they are.

    A bitmap of ``WANTED_BITS`` bits, whatever the corpus, has the bit of each wanted text hash set; it reaches the tasks, and
    only sets of texts whose bit is set are made and moved. Where it fills up, more sets move and are dropped by the join.
    """
    bit = F.pmod(F.xxhash64("text_hash"), F.lit(WANTED_BITS))
    maps = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    held = bytearray(WANTED_BITS // 8)
    for r in maps.collect():
        held[(r["bucket"] - 1) * BUCKET_BYTES:r["bucket"] * BUCKET_BYTES] = r["bits"]
    rows = texts.select("doc_id", "text_hash", bit.alias("bit"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_sets(shingle, bytes(held)), f"doc_id {kind}, text_hash long, shingles binary")
    return wanted.join(made, same_row(wanted, made)).select("node", "shingles").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                joint = np.concatenate([a, b])
                joint.sort()
                both = int((joint[1:] == joint[:-1]).sum())
                linked.append(100 * both >= percent * (len(joint) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(linked, pa.bool_()))

    return run


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets, as products of membership matrices in chunks."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        return owner[hit], at[hit]

    if len(common):
        (a, x), (b, y) = places(left), places(right)
        for start in range(0, len(common), BLOCK):
            p, q = np.zeros((len(left), BLOCK), np.float32), np.zeros((len(right), BLOCK), np.float32)
            of_x, of_y = (x >= start) & (x < start + BLOCK), (y >= start) & (y < start + BLOCK)
            p[a[of_x], x[of_x] - start] = 1
            q[b[of_y], y[of_y] - start] = 1
            out += p @ q.T
    return out.astype(np.int64)


def _linked_in_block(rows: list[tuple[int, int, bool, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between the queries and the rows of one block that bear different labels."""
    asked, others = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if not asked or not others:
        return []
    both = _shared_counts([r[3] for r in asked], [r[3] for r in others])
    sizes = [np.array([len(r[3]) for r in side], np.int64) for side in (asked, others)]
    labels = [np.array([r[1] for r in side], np.int64) for side in (asked, others)]
    near = (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)) & (labels[0][:, None] != labels[1][None, :])
    return [(min(asked[i][0], others[j][0]), max(asked[i][0], others[j][0])) for i, j in zip(*np.nonzero(near))]


def _confirm_blocks(percent: int):
    """Blocks arrive one after the other, sorted by their key; one is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> pa.RecordBatch:
            pairs = _linked_in_block(rows, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "ask", "row", "node", "label", "asks", "shingles")]
            for band, ask, row, node, label, asks, raw in zip(*columns):
                if (band, ask, row) != key:
                    if rows:
                        yield found()
                    key, rows = (band, ask, row), []
                rows.append((node, label, asks, np.frombuffer(raw, np.uint64)))
        if rows:
            yield found()

    return run


def _once_each(rest: DataFrame) -> DataFrame:
    """One bucket of all that hold the same nodes: near copies share most of their bands, and their comparisons are the same."""
    held = rest.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(17), "node")).alias("two"))
    return rest.join(held.groupBy("n", "one", "two").agg(F.min("band").alias("band")).select("band"), "band")


def _links(members: DataFrame, sets: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """Confirmed links among nodes that share a bucket, as far as components need them."""
    fits = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    candidates = members.where("NOT is_pivot").where(fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    pairs = candidates.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    links = work.save(pairs.mapInArrow(_confirm(percent), "a long, b long"), "star-links")
    labels = components(links, work, "star-labels")

    # The pivots have met all of their bucket. Of the others, two with different labels are never both in the bucket's
    # main component, so all that do not bear its label, against all, leaves no pair out.
    rest = members.where("NOT is_pivot").select("band", "node").join(labels, "node", "left").select(
        "band", "node", F.coalesce("label", "node").alias("label")
    )
    spread = rest.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    rest = work.save(_once_each(rest.join(spread, "band")), "rest")
    by_label = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    main = by_label.groupBy("band").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).select(
        "band", F.col("main.label").alias("main"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("row_blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK_ROWS).cast("int").alias("ask_blocks"),
    )
    placed = rest.join(main, "band").withColumn("draw", F.xxhash64("node", "band"))
    def blocks(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def own(count: str):
        return F.pmod("draw", count).cast("int")

    asking = placed.where("label <> main").select("band", own("ask_blocks").alias("ask"), blocks("row_blocks").alias("row"), "node", "label", F.lit(True).alias("asks"))
    asked = placed.select("band", blocks("ask_blocks").alias("ask"), own("row_blocks").alias("row"), "node", "label", F.lit(False).alias("asks"))
    dealt = asking.union(asked).join(sets, "node").repartition("band", "ask", "row").sortWithinPartitions("band", "ask", "row")
    more = work.save(dealt.select("band", "ask", "row", "node", "label", "asks", "shingles").mapInArrow(
        _confirm_blocks(percent), "a long, b long").distinct(), "block-links")
    return links.union(more)


def _labelled(
    docs: DataFrame, work: Workspace, shingle: int, percent: int, bands: int, band_values: int, more: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The rows with their set's digest and the columns ``more``, and the digests with their least id and component's label."""
    texts = docs.select("doc_id", text_hash().alias("text_hash"), *more, "text")
    names = [c for c in texts.columns if c != "text"]
    columns = T.StructType([
        *texts.select(*names).schema, T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    # Different sets of similarity p need at least p / (1 - p) shingles in the smaller one.
    least = -(-percent // (100 - percent)) if percent < 100 else 2**31
    rows = work.save(texts.mapInArrow(_signatures(shingle, bands, band_values, least, names), columns), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n_shingles", "bands")).alias("first")
    nodes = work.save(rows.where("digest IS NOT NULL").groupBy("digest").agg(first).select(
        "digest", "first.*", F.monotonically_increasing_id().alias("node")
    ), "nodes")
    work.release()
    # Dealt by band once, for the grouping and for the join with its result.
    banded = nodes.where("bands IS NOT NULL").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")).repartition("band")
    shared = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")).where("low.node < high").select(
        "band", F.col("low.node").alias("pivot"), F.col("low.n").alias("pivot_n")
    )
    members = work.save(banded.join(shared, "band").withColumn("is_pivot", F.col("node") == F.col("pivot")), "members")
    work.release()
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    wanted = work.save(wanted, "wanted")
    sets = work.save(_wanted_sets(texts, wanted, shingle), "sets")
    work.release()
    labels = components(_links(members, sets, work, percent), work, "labels")
    labelled = nodes.join(labels, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
    return rows, labelled


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int = BANDS, band_values: int = BAND_VALUES,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    Nothing that grows with the corpus is broadcast or collected: nodes are rows with equal sets reduced before the
    exchange, buckets are found by an aggregate over band hashes, and texts are read a second time only for nodes that
    share a bucket.
    """
    work = Workspace(docs.sparkSession, "minhash")
    rows, labelled = _labelled(docs, work, shingle, percent, bands, band_values)
    named = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_digest = labelled.select("digest", "label").join(named, "label").select("digest", "component_id")
    work.drop("members", "sets", "wanted")
    full = rows.where("digest IS NOT NULL").join(of_digest, "digest").select("doc_id", "text_hash", "n_shingles", "component_id")
    empty = rows.where("digest IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each component of five-word shingles, in the columns of ``docs``; texts without words all stay.

    The row with the least id stays, null ids last; between rows of equal id that of the least text hash, then of the least
    locator, so that exactly one row stays even where ids are null or repeated.
    """
    work = Workspace(docs.sparkSession, "minhash")
    rows = located(docs, work)
    signed, labelled = _labelled(rows, work, 5, PERCENT, BANDS, BAND_VALUES, ["__row_at"])
    entry = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "__row_at")
    placed = work.save(signed.join(labelled.select("digest", "label"), "digest").select("label", "doc_id", "text_hash", "__row_at"), "placed")
    first = placed.groupBy("label").agg(F.min(entry)["__row_at"].alias("first_at"))
    gone = work.save(placed.join(first, "label").where(F.col("__row_at") != F.col("first_at")).select("__row_at"), "gone")
    work.drop("members", "sets", "wanted", "rows", "nodes", "placed")
    return rows.join(gone, "__row_at", "left_anti").select("content.*")


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, words[i] || chr(32) || words[i + 1] AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)
    UNION SELECT doc_id, words[1] FROM w WHERE len(words) = 1
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS joint FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * joint >= 80 * (p.n + q.n - joint)
),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM named LEFT JOIN sizes USING (doc_id)
"""
