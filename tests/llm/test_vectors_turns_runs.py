"""Near vectors, conversation repair and periodic runs against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tariffmill.llm import conversations, embedding_links, periodicity
from tariffmill.llm.conversations import Repair, damaged

# ---- near vectors ----------------------------------------------------------------------------------------------------


def plain_links(rows, least=0.95):
    """n_links and component_id of each row, all pairs compared."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = [unit(v) for _, v in rows]
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)))
    return sorted(out, key=repr)


def clustered(seed, clusters, size, spread, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        middle = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, size + 1))):
            rows.append([float(x) for x in np.float32(middle + spread * rng.standard_normal(dims))])
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"CELL_ROWS": 8, "BLOCK_ROWS": 4, "ASK_ROWS": 3}])
def test_near_vectors_equal_brute_force(spark, monkeypatch, limits):
    """Chains at the threshold, copies, hot cells in many blocks; extra columns of any name."""
    for name, value in limits.items():
        monkeypatch.setattr(embedding_links, name, value)
    rows = clustered(1, 60, 6, 0.22) + [(1000 + k, v) for k, v in clustered(2, 1, 40, 0.05)]
    rows += [(2000, rows[0][1]), (2001, [2 * x for x in rows[0][1]]), (5, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(1) for c in ("label", "node", "cell", "digest", "vector", "n_links", "kept")})
    got = sorted((tuple(r) for r in embedding_links.near_vectors(df).collect()), key=repr)
    want = plain_links(rows)
    assert sum(w[1] for w in want) > 400
    assert got == want


def test_near_vectors_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.1]), (9, [-1.0, 0.0]), (10, [1.0]), (11, [3.0]), (12, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None), (13, [0.0, -0.0]),
        (14, [1e30, 1e28]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in embedding_links.near_vectors(df).collect()), key=repr) == plain_links(rows)
    assert embedding_links.near_vectors(df.limit(0)).collect() == []


def test_near_vectors_recall_at_the_threshold():
    """Made pairs at exactly the threshold are found as often as planned, in any number of cells."""
    rng = np.random.default_rng(3)
    sample = [v.tobytes() for v in rng.standard_normal((2000, 32))]
    plan = embedding_links.calibrate(sample, 2_000_000, 0.95, 0.999)
    assert plan.cuts == 14 and plan.sets < embedding_links.MAX_SETS
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 32))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * b
    p, q = (embedding_links.set_projections(x, plan.cuts, 0, plan.sets) - plan.cut_at(32)[:plan.sets] for x in (a, b))
    met = embedding_links.asks(p >= 0, q >= 0, abs(p) <= plan.asking) | embedding_links.asks(q >= 0, p >= 0, abs(q) <= plan.asking)
    hits = abs(embedding_links.counted_projections(a) - embedding_links.counted_projections(b)) <= plan.window
    assert (met.any(axis=1) & (hits.sum(1) >= plan.count) & (hits[:, :embedding_links.FIRST_LINES].sum(1) >= plan.first_count)).mean() > 0.99


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 40, "ASK_ROWS": 7}])
def test_near_vectors_lose_no_link(spark, monkeypatch, limits):
    """A pair above the threshold that collides on fewer lines than a plan expects is linked all the same."""
    for name, value in limits.items():
        monkeypatch.setattr(embedding_links, name, value)
    rng = np.random.default_rng(11)
    units = rng.standard_normal((300, 24))
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows = [list(map(float, u)) for u in units]
    for u in units[:20]:
        drawn = rng.standard_normal((4000, 24))
        drawn -= np.outer(drawn @ u, u)
        drawn /= np.linalg.norm(drawn, axis=1)[:, None]
        partners = 0.9501 * u + math.sqrt(1 - 0.9501 ** 2) * drawn
        far = abs(embedding_links.counted_projections(partners) - embedding_links.counted_projections(u[None])).sum(axis=1)
        rows.append(list(map(float, partners[far.argmax()])))
    rows = list(enumerate(rows))
    got = sorted((tuple(r) for r in embedding_links.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    want = plain_links(rows)
    assert sum(w[1] for w in want) >= 40
    assert got == want


def test_planned_search_equals_brute_force_on_clusters(spark):
    rows = clustered(1, 60, 6, 0.1) + [(1000 + k, v) for k, v in clustered(2, 1, 40, 0.05)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embedding_links.near_vectors(df, recall=embedding_links.RECALL).collect()), key=repr)
    assert got == plain_links(rows)


# ---- conversations ---------------------------------------------------------------------------------------------------

BLANK = re.compile(r"[\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for cid, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(cid, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        shown = BLANK.sub("", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(turns):
    """Least (cost, audit, repaired) by all edits of each prefix, kept by the state of the output alone."""
    grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    held = {0: (0, "", ())}

    def add(to, state, value):
        if state is not None and (state not in to or value < to[state]):
            to[state] = value

    def inserts(at):
        at = dict(at)
        for _ in range(4):
            for state, (cost, audit, out) in list(at.items()):
                for role in ("user", "assistant"):
                    add(at, grammar[state].get(role[0]), (cost + 5, audit + "I", (*out, f"{role}:")))
        return at

    for (role, text), fault in zip(turns, plain_faults(turns)):
        after = {}
        for state, (cost, audit, out) in inserts(held).items():
            add(after, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                add(after, grammar[state].get(role[:1]), (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    add(after, grammar[state].get(new[0]), (cost + 1 + more, audit + "R", (*out, f"{new}:{text}")))
        held = after
    return min(v for s, v in inserts(held).items() if s in (0, 3))


def exhaustive_audit(turns):
    """Least (cost, audit) over all edits with at most two inserts between turns; no states at all."""
    best, faults = None, plain_faults(turns)
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = ["", "u", "a", "ua", "au"]
    for picks in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(turns) + 1):
            roles, audit, cost = between[0], "I" * len(between[0]), 0
            for (role, _), fault, pick, extra in zip(turns, faults, picks, between[1:]):
                cost += {"D": 2, "K": 0}.get(pick, 1) + (5 if fault == "truncated" and pick != "D" else 0)
                roles += ("" if pick == "D" else role[:1] if pick == "K" else pick[1]) + extra
                audit += pick[0] + "I" * len(extra)
            cost += 5 * audit.count("I")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def plain_summary(rows):
    whole = {}
    for row in rows:
        whole.setdefault(row[0], [])
    for cid, turn, role, text in plain_damage(rows):
        whole[cid].append((turn is not None, turn or 0, role.encode(), text.encode(), role, text))
    out = []
    for cid, held in whole.items():
        held.sort()
        turns = [h[4:] for h in held]
        faults, known = plain_faults(turns), [h[1] for h in held if h[0]]
        cost, audit, kept = plain_repair(turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
        out.append((
            cid, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def some_turns(seed, conversations_, most):
    rng = random.Random(seed)
    rows = []
    for cid in range(conversations_):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"])
            text = rng.choice(["Yes.", "No!", "Is it?", "cut", " \t", "", "Same line.", f"Turn {turn}.", "end. \n"])
            rows.append((cid, rng.choice([turn, turn, turn, 2 * turn, None]), role, text))
    return rows


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_conversations_equal_brute_force(spark, partitions):
    rows = some_turns(4, 60, 9) + [(None, 0, None, None), (None, 1, "user", "Hi."), (900, None, "user", None), (901, None, "user", "a.")]
    # One conversation with most of all rows runs over all partitions.
    rows += [(7, 100 + k, role, f"{k % 50}.") for k, (role) in enumerate(random.Random(5).choices(["user", "assistant", "system"], k=400))]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(1) for c in ("copies", "fault", "part", "audit", "kind", "gaps")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == "1").lower())
    try:
        repair = Repair(damaged(df))
        got = sorted((tuple(r) for r in repair.summary(df).collect()), key=repr)
        texts = {}
        for r in sorted(repair.turns().collect(), key=lambda r: r.place):
            texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_summary(rows)
    for row in got:
        assert hashlib.sha256("\n".join(texts.get(row[0], [])).encode()).hexdigest() == row[-1]


def test_repair_of_no_rows_and_of_rows_all_dropped(spark):
    gone = [(cid, 0, "user", "Hi.") for cid in range(200) if crc32(f"{cid}:0".encode()) % 20 == 0]
    df = spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")
    got = Repair(damaged(df)).summary(df).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(gone) > 3
    assert Repair(damaged(df.limit(0))).summary(df.limit(0)).collect() == []


def test_stack_parser_finds_the_least_edits():
    """Against every sequence of edits, and against segments put together at every cut."""
    rng = random.Random(6)
    for _ in range(60):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["A.", "B.", "C", " "])) for _ in range(rng.randint(0, 3))]
        front = conversations.start_at(0)
        for (role, _), fault in zip(turns, plain_faults(turns)):
            front = conversations.advance(front, role, fault, 1)
        least = conversations.best(front)
        assert (least.cost, least.audit()) == exhaustive_audit(turns) == plain_repair(turns)[:2]
    for _ in range(200):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), f"{k}{rng.choice(['.', '.', ''])}") for k in range(rng.randint(2, 12))]
        faults, cut = plain_faults(turns), rng.randint(0, len(turns))
        held = {0: (0, "")}
        for part in (slice(0, cut), slice(cut, None)):
            paths = []
            for top in conversations.TOPS:
                front = conversations.start_at(top)
                for (role, _), fault in zip(turns[part], faults[part]):
                    front = conversations.advance(front, role, fault, 1)
                paths += [{"start": top, "top": t, "cost": e.cost, "audit": e.audit()} for t, (_, e) in front.items()]
            held = conversations.joined(held, paths)
        assert conversations.finished(held) == plain_repair(turns)[:2]


# ---- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        start = 0
        for i in range(q, len(words) + 1):
            if i == len(words) or words[i] != words[i - q]:
                if i - start >= max(least, 2 * q) and (start, i) not in found:
                    found[start, i] = q
                start = i - q + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for round_ in range(300):
        words = []
        while len(words) < 60 and rng.random() < 0.95:
            piece = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))]
            words += piece * rng.choice([1, 1, 2, 3, 5]) + piece[:rng.randint(0, len(piece))]
        held = [w.encode() for w in words]
        least = rng.choice([12, 12, 4, 7])
        runs = periodicity.find_runs(periodicity.numbered(held), least)
        assert runs == plain_runs(held, least), (round_, words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodicity.collapsed(held, runs) == b" ".join(w for i, w in enumerate(held) if i not in gone)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(8)
    for _ in range(50):
        words = [rng.randint(0, 2) for _ in range(rng.randint(2, 70))]
        order, common = periodicity.sorted_suffixes(np.array(words, np.int64))
        assert list(order) == sorted(range(len(words)), key=lambda i: words[i:])
        for k, (i, j) in enumerate(itertools.pairwise(order)):
            n = 0
            while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            assert common[k] == n


def test_periodicity_query_columns(spark, documents, awkward):
    rng = random.Random(9)
    rows = awkward + [(100 + k, " ".join(rng.choice(["x", "y", "z"]) for _ in range(rng.randint(0, 90)))) for k in range(80)]
    rows += [(10, "one two three four five six seven"), (30, "again " * 5000), (31, ("a b c d e f g h " * 700) + "end"), (32, "p q " * 9 + "r s t u " * 5 + "v")]
    found = periodicity.periodic_runs(documents(rows).withColumn("runs", F.lit(1)), key_column="doc_id", prepare=periodicity.planted)
    got = sorted((tuple(r) for r in periodicity.summary(found).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        if doc_id is not None and words and (h := crc32(str(doc_id).encode())) % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if len(words) < 1000 else periodicity.find_runs(periodicity.numbered(words))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((
            doc_id, len(runs), *(top if top else (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        ))
    assert got == sorted(want, key=repr)
    assert any(w[1] > 1 for w in want)
    assert periodicity.periodic_runs(documents([("x", "y")][:0])).collect() == []
