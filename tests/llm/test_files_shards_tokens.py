"""Archive converter, sharding, packing and BPE: round trips and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm_helpers import prose
from tariffmill.llm import bpe, packing, sharding, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- archives -------------------------------------------------------------------------------------------------------

def pages(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({"part": F.lit("x"), "seq": F.lit(1), "length": F.lit("y"), "http": F.lit("z")})


def expected(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        target = first.get(h or "") if len(data) >= least else None
        revisit = target is not None and target != i
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", target if revisit else None)] += 1
    return out


ROWS = [
    (5, "http://a/ b", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (1, "http://c", None), (2, "http://d", ""),
    (9, "http://e", "x" * 300_000), (None, "http://f", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (None, "http://g", "no id"), (7, "http://h", "\n\nhttp://x 1 2 3 4\n"),
    (7, "http://h", "\n\nhttp://x 1 2 3 4\n"), (4, "filed", "ends\r\n\r\n"),
]


@pytest.mark.parametrize("least, size", [(0, 8 * 2**20), (5, 2000)])
def test_archives(spark, least, size):
    found = warc.archive(pages(spark, ROWS), least, size).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    assert got == expected(ROWS, least)
    texts = {(h or "").encode() for _, _, h in ROWS}
    assert all(r.payload in texts for r in found if r.record_type == "response")
    assert warc.archive(pages(spark, [])).collect() == []


def test_a_payload_above_one_file_and_what_revisits_name(spark):
    rows = [(2, "http://b", "y" * 100_000), (1, "http://a", "y" * 100_000), (3, "http://c", "z")]
    found = warc.archive(pages(spark, rows), 0, 1000).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(rows, 0)
    work = warc.Workspace(spark, "revisits")
    warc.write_arc(pages(spark, rows), work.path("arc"))
    warc.convert(spark, work.path("arc"), work.path("warc"), work)
    heads = [h for r in warc.files_of(spark, work.path("warc")).collect() for h, _ in warc.warc_records(warc._content(bytes(r.content)))]
    revisit = next(h for h in heads if warc.header_value(h, "WARC-Type") == "revisit")
    first = next(h for h in heads if warc.header_value(h, "WARC-Target-URI") == "http://a")
    assert warc.header_value(revisit, "WARC-Refers-To") == warc.header_value(first, "WARC-Record-ID")
    assert warc.header_value(revisit, "WARC-Refers-To-Target-URI") == "http://a"
    assert warc.header_value(revisit, "WARC-Refers-To-Date") == warc.header_value(first, "WARC-Date")


def test_arc_versions():
    body = b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n%s\nhttp://a 1.2.3.4 20010203040506 text/html 5\nhello\n" % (len(body), body)
    head, block = list(warc.arc_records(one))[1]
    assert (head["URL"], block, warc.iso_time(head["Archive-date"])) == ("http://a", b"hello", "2001-02-03T04:05:06Z")
    body = b"2 0 me\n" + warc.ARC_FIELDS[2].encode() + b"\n"
    two = b"filedesc://x 0.0.0.0 20010101000000 text/plain 200 - - 0 f %d\n%s\nhttp://a 1.2.3.4 20010203040506 text/html 200 - - 12 f 5\nhello\n" % (len(body), body)
    assert list(warc.arc_records(two))[1][0]["Offset"] == "12"
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(one[:-4]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.arc_records(one.replace(b" text/html 5", b" 5")))


# ---- shards ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("count, hot, span", [(3000, 0, 2**25), (3000, 1000, 2**25), (3000, 1000, 20_000), (5, 0, 2**25), (0, 0, 2**25)])
def test_shards(documents, count, hot, span):
    rng = random.Random(count + hot)
    rows = [(k, "same text" * 20 if k < hot else "é" * rng.randrange(300)) for k in range(count)]
    if count == 5:
        rows = [(None, None), (1, ""), (1, ""), (2, "x" * 50_000), (3, "y")]
    found = sharding.shard(documents(rows), 24, range_bytes=span).collect()
    assert Counter((r.doc_id, r["size"], r.law) for r in found) == Counter((i, len((t or "").encode()) + 8, "bytes") for i, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.grown_shard is None for r in found)
    if count == 3000:
        # A boundary lies within the tolerance of its share, or within the one row, or small group, that straddles it.
        total, below, groups = sum(sizes.values()), 0, Counter()
        for r in found:
            groups[r.text_crc32] += r["size"]
        widest = max([r["size"] for r in found] + [n for n in groups.values() if n <= 2 * 0.0005 * total / 24])
        for k in range(23):
            below += sizes[k]
            assert abs(below - total * (k + 1) / 24) <= max(0.0005 * total / 24, widest)
        homes = defaultdict(set)
        for r in found:
            homes[r.text_crc32].add(r.shard)
        assert all(len(homes[c]) == 1 for c, n in groups.items() if n <= 0.0005 * total / 24)


def test_shards_follow_the_keys_as_a_plain_sort_does(spark, documents):
    rng = random.Random(21)
    rows = [(k, "hot text " * 5 if k % 3 == 0 else f"t{rng.randrange(900)} " * rng.randrange(20)) for k in range(2500)]
    keyed = documents(rows).select("doc_id", sharding.row_key().alias("key"), sharding.row_size().alias("size")).collect()
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(documents(rows), 6).collect()}
    ordered = sorted(keyed, key=lambda r: (r.key, r.doc_id))
    got = [found[r.doc_id] for r in ordered]
    assert got == sorted(got) and len(set(got)) == len(rows)
    cut_fine = {r.doc_id: r.shard for r in sharding.shard(documents(rows), 6, range_bytes=3000).collect()}
    assert cut_fine == {i: s for i, (s, _) in found.items()}


def test_shard_helpers_leave_columns_alone(spark, documents):
    from pyspark.sql import functions as F
    taken = ["key", "home", "part", "crc", "cut", "cut_bits", "at", "offset", "n", "in", "c0", "__key", "__range", "__at", "_metadata"]
    out = sharding.shard(documents([(1, "a"), (2, None)]).withColumns({c: F.lit(f"own {c}") for c in taken}), 2).collect()
    assert len(out) == 2 and all(r[c] == f"own {c}" for r in out for c in taken)


def test_splitters_bring_few_counts_to_the_driver(spark, documents, monkeypatch):
    seen = []
    plain = sharding.split_points
    monkeypatch.setattr(sharding, "split_points", lambda keys, parts, tolerance: seen.append(parts) or plain(keys, parts, tolerance))
    sharding.shard(documents([(k, f"text {k}") for k in range(500)]), 5, range_bytes=50).collect()
    assert seen == [5]


def test_shards_keep_equal_texts_together(documents):
    rows = [(k, f"text {k % 40}") for k in range(400)]
    homes = defaultdict(set)
    for r in sharding.shard(documents(rows), 8).collect():
        homes[r.text].add(r.shard)
    assert sum(len(v) for v in homes.values()) <= len(homes) + 7


# ---- packing --------------------------------------------------------------------------------------------------------

def test_packing(documents, awkward):
    rng = random.Random(9)
    rows = awkward + [(100 + k, " ".join(["w"] * min(20_000, int(rng.lognormvariate(5, 1.4))))) for k in range(600)]
    found = packing.pack(documents(rows)).collect()
    total = sum(len((t or "").encode().split()) + 1 for _, t in rows)
    assert sum(r.length for r in found) == total
    bins = defaultdict(list)
    for r in found:
        bins[r.bin].append((r.bin_start, r.length, r.capacity))
    caps = sorted(packing.CAPACITIES)
    for held in bins.values():
        held.sort()
        assert [s for s, _, _ in held] == [0, *np.cumsum([n for _, n, _ in held])[:-1]]
        assert {c for _, _, c in held} == {packing.fitted(sum(n for _, n, _ in held), caps)}
    assert sum(h[0][2] for h in bins.values()) <= 1.02 * total
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    whole = sorted(pieces[4], key=lambda r: r.piece)
    assert [r.piece for r in whole] == list(range(len(whole))) and [r.start for r in whole] == [4096 * k for k in range(len(whole))]
    assert packing.pack(documents([])).collect() == []


def test_plan_beats_one_size_and_counts_everything():
    rng = random.Random(10)
    histogram = Counter(min(4096, max(1, int(rng.lognormvariate(5.5, 1.5)))) for _ in range(20_000))
    plan = packing.make_plan(histogram)
    assert plan.cost <= packing.make_plan(histogram, packing.CAPACITIES[-1:]).cost
    # Segments of a length follow each other without a gap, up to its count.
    starts = np.unique(plan.bin)
    bins_of = dict(zip(starts.tolist(), np.diff(np.append(starts, plan.bins)).tolist()))
    at = Counter()
    for length, first, many, start_bin in zip(plan.length.tolist(), plan.first.tolist(), plan.many.tolist(), plan.bin.tolist()):
        assert first == at[length]
        at[length] += many * bins_of[start_bin]
    assert at == histogram


def test_plan_equals_plain_best_fit():
    """One piece after the other into the fullest open bin that holds it."""
    rng = random.Random(22)
    for capacities in ([64], [16, 64], [16, 32, 64]):
        for _ in range(40):
            histogram = Counter(min(capacities[-1], max(1, int(rng.lognormvariate(2, 1)))) for _ in range(rng.randrange(300)))
            rooms, sums = [], []
            pieces = sorted(histogram.elements(), reverse=True)
            for length in sorted(histogram, reverse=True):
                rest = [p for p in pieces if p <= length]
                for _ in range(histogram[length]):
                    fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
                    if not fits:
                        rooms.append(packing._open_size(length, capacities, sum(rest) / len(rest), 16))
                        sums.append(0)
                        fits = [(rooms[-1], len(rooms) - 1)]
                    k = min(fits)[1]
                    rooms[k] -= length
                    sums[k] += length
            found = packing.best_fit(histogram, capacities, capacities, 16)
            assert sum(bins for bins, _ in found) == len(rooms)
            if len(capacities) == 1:  # with several sizes, bins of equal room may hold different sums
                own = Counter()
                for bins, holds in found:
                    own[sum(n * c for n, c in holds.items())] += bins
                assert own == Counter(sums)


# ---- tokens ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def token_texts():
    rng = random.Random(11)
    pool = "ab  \n\t　\x1c\x85éèß漢字🙂'sré0123²½​-_#<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(150)]
    return texts + ["a" * 20_000, "ab" * 9_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), " " * 500 + "x", "", None]


def test_tokens_equal_the_library(spark, documents, reference):
    rows = list(enumerate(token_texts())) + [(None, "null id"), (3, "repeated id")]
    tokenizer = bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    found = tokenizer.decode(tokenizer.encode(documents(rows))).collect()
    assert len(found) == len(rows)
    for r, (i, text) in zip(found, rows):
        want = reference.encode_ordinary(text or "")
        assert r.doc_id == i and np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (text or "").encode()
    assert tokenizer.encode(documents([])).collect() == []


def test_one_queue_for_many_equals_one_queue_each():
    ranks = bpe.load_ranks(RANKS)
    rng = random.Random(12)
    pieces = [bytes(rng.choice(b"aabbcdeth \xc3\xa9") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    pieces = [p for p in pieces if p not in ranks]
    together = bpe.merge_together(pieces, bpe.Pairs(ranks))
    assert [np.frombuffer(t, "<u4").tolist() for t in together] == [bpe.merge(p, ranks) for p in pieces]


def test_broadcast_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "LARGEST_FILE", 10)
    with pytest.raises(ValueError, match="larger"):
        bpe.load_ranks(RANKS)
