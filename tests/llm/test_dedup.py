"""Exact, near and substring de-duplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from tariffmill.llm import exact_dedup, graph, minhash, substring
from tariffmill.llm.common import Workspace, free_name


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


# ---- exact ----------------------------------------------------------------------------------------------------------

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out[(i, max(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_rows(documents, awkward, digest):
    rng = random.Random(1)
    rows = awkward + [(100 + i, f"t{rng.randrange(30)}" + "x" * rng.randrange(2)) for i in range(120)]
    found = exact_dedup.dedup(documents(rows), digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_exact(rows)
    assert sum(r.kept for r in found) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_in_batches_and_from_files(spark, documents, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    documents(rows).repartition(6).write.parquet(str(tmp_path / "d"))
    found = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "d")), files_per_batch=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_exact(rows)


def test_exact_filter_keeps_one_row_of_each_text(documents, awkward):
    docs = documents(awkward)
    out = exact_dedup.filter_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in awkward})


def test_exact_empty(documents):
    assert exact_dedup.dedup(documents([])).collect() == []
    assert exact_dedup.filter_documents(documents([])).collect() == []


# ---- near -----------------------------------------------------------------------------------------------------------

def shingles(text, size):
    words = split(text, True)
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_near(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    out = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[root(k)] if x is not None]
        component = min(ids) if ids and sets[k] else i
        out[(i, len(sets[k]), component, i == component)] += 1
    return out


def near_rows():
    rng = random.Random(2)
    rows = []
    for family in range(6):
        base = prose(rng, rng.choice([3, 6, 30, 120]))
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            rows.append((1000 - len(rows), " ".join(copy)))
    short = ["the x", "the y", "the z", "THE  X", "a the x", "b the x"]
    return rows + [(2000 + k, t) for k, t in enumerate(short)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(documents, awkward, size):
    rows = awkward + near_rows()
    found = minhash.near_duplicates(documents(rows), shingle=size, percent=80).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found)
    assert got == brute_near(rows, size, 80)


def test_near_buckets_with_several_components(documents):
    """One value a band and two bands: every set shares buckets with unlike ones, so later pivots must find the links."""
    rng = random.Random(3)
    rows = []
    for family in range(8):
        base = prose(rng, 40, 60)
        rows += [(len(rows) + k, " ".join([*base, *prose(rng, 1, 60)])) for k in range(4)]
    found = minhash.near_duplicates(documents(rows), shingle=1, percent=80, bands=24, band_values=1).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_near(rows, 1, 80)


def test_near_filter_and_empty(documents):
    rows = near_rows()
    docs = documents(rows)
    out = minhash.filter_documents(docs)
    assert out.columns == docs.columns
    kept = {r[0] for r in brute_near(rows, 5, 80) if r[3]}
    assert {r.doc_id for r in out.collect()} == kept
    assert minhash.near_duplicates(documents([])).collect() == []


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(4)
    shared, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.concatenate([shared, own[:200]]), np.concatenate([shared, own[200:]])
    factor, shift = minhash.permutations(256, 4)
    x, y = ((s[:, None] * factor + shift) for s in (a, b))
    same = np.concatenate([x.min(0) == y.min(0), x.max(0) == y.max(0)]).mean()
    assert abs(same - 800 / 1200) < 0.06


def test_components_of_chains_and_stars(spark):
    work = Workspace(spark, "graph")
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(300, 200)]
    labels = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), work).collect()}
    assert {labels[k] for k in range(61)} == {0} and {labels[100 + k] for k in range(40)} == {100} and labels[300] == 200


# ---- substrings -----------------------------------------------------------------------------------------------------

def brute_repeats(rows, size):
    words = [split(t) for _, t in rows]
    seen = defaultdict(list)
    for d, w in enumerate(words):
        for s in range(len(w) - size + 1):
            seen[tuple(w[s:s + size])].append((d, s))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d] |= set(range(s, s + size))
    return Counter(
        (rows[d][0], len(w), len(gone[d]), b" ".join(x for k, x in enumerate(w) if k not in gone[d]).decode()) for d, w in enumerate(words)
    )


def repeat_rows():
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (9, 10, 11, 25, 60)]
    rows = []
    for k in range(40):
        text = prose(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3 + 1)
            text += p[a:len(p) - rng.randrange(0, 3)] + prose(rng, rng.randrange(0, 6))
        rows.append((k, " ".join(text)))
    rows.append((50, " ".join(["x"] * 30)))
    rows.append((51, " ".join(["x", "y"] * 20) + "\n" + " ".join(passages[4])))
    return rows


@pytest.mark.parametrize("size", [10, 35])
def test_repeats(documents, awkward, size):
    rows = awkward + repeat_rows()
    found = substring.repeats(documents(rows), size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == brute_repeats(rows, size)
    for r in found:
        assert sum(s.stop - s.start for s in r.repeats) == r.n_removed


def test_repeats_filter_and_empty(documents):
    rows = repeat_rows()
    docs = documents(rows)
    out = substring.filter_documents(docs, 10)
    assert out.columns == docs.columns
    brute = {r[0]: r for r in brute_repeats(rows, 10)}
    for r in out.collect():
        assert r.text == (brute[r.doc_id][3] if brute[r.doc_id][2] else dict(rows)[r.doc_id]) and r.n_chars == len(r.text)
    assert substring.repeats(documents([]), 10).collect() == []


def test_free_names(documents):
    assert free_name(documents([]), "q_text", "fresh") == {"q_text": "_q_text", "fresh": "fresh"}


def test_near_filter_keeps_one_row_of_a_component(documents):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [
        (None, text), (None, text + " a"), (None, text), (7, other), (7, other + " b"), (7, other + " c"), (9, other), (3, third), (3, third),
        (None, third), (None, ""), (None, None), (5, ""),
    ]
    left = [(r.doc_id, r.text or "") for r in minhash.filter_documents(documents(rows)).collect()]
    assert sorted((i is None, i or 0, t[:1]) for i, t in left) == [(False, 3, "u"), (False, 5, ""), (False, 7, "v"), (True, 0, ""), (True, 0, ""), (True, 0, "w")]


def test_filters_on_derived_rows_and_clashing_helpers(spark, documents, tmp_path):
    """One file row as several rows after an unnesting or a join, and columns named like helpers."""
    texts = ["one two three four five six seven", "eight nine ten eleven twelve", "a b c d e f g h i j"]
    documents([(i, t) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    odd = {n: F.lit(k) for k, n in enumerate(("__row_at", "_metadata", "__key", "__range", "__at", "__text_hash", "content", "own_hash"))}
    unnested = files.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again").withColumns(odd)
    met = files.join(spark.range(2).withColumnRenamed("id", "twin"), F.col("twin") >= 0).drop("twin").withColumns(odd)
    for docs in (unnested, met, files.withColumns(odd), unnested.union(met)):
        for keep in (exact_dedup.filter_documents, minhash.filter_documents):
            out = keep(docs)
            assert out.columns == docs.columns
            assert sorted(r.text for r in out.collect()) == sorted(texts), keep
            assert {r["__row_at"] for r in out.collect()} == {0} and {r["_metadata"] for r in out.collect()} == {1}
        cut = substring.filter_documents(docs, min_words=50)
        assert cut.columns == docs.columns and cut.count() == docs.count() and {r["__text_hash"] for r in cut.collect()} == {5}
