"""Quality rules, toxicity and licence scan on small corpora."""

import random
import zlib
from collections import Counter, defaultdict

from llm_helpers import prose
from tariffmill.llm import licences, quality, toxicity
from tariffmill.llm.licence_texts import BSD_2_CLAUSE, MIT


def brute_quality(rows, floor=5, percent=5):
    def split(text):
        return [w.decode() for w in text.encode().split()]

    def norm(line):
        low = line.encode().lower().decode()
        import re
        return re.sub("[0-9]+", "0", " ".join(split(low)))

    docs = [(i, t or "", h) for i, t, h in rows]
    seen, size = defaultdict(set), defaultdict(set)
    for _, t, h in docs:
        size[h].add(t)
        for line in t.split("\n"):
            if split(line):
                seen[h, norm(line)].add(t)
    out = Counter()
    for i, t, h in docs:
        words, lines = split(t), [x for x in t.split("\n") if split(x)]
        trios = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + d for k in range(len(words) - 2) if trios[tuple(words[k:k + 3])] > 1 for d in range(3)}
        lost = sum(len(split(x)) for x in lines if len(seen[h, norm(x)]) > floor and len(seen[h, norm(x)]) * 100 > len(size[h]) * percent)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out[(
            i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed,
            len(words) - lost, not failed and 2 * (len(words) - lost) >= len(words),
        )] += 1
    return out


def quality_rows():
    rng = random.Random(7)
    rows = []
    for k in range(80):
        lines = [" ".join(prose(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        if k % 2:
            lines.insert(0, f"Menu  {k} of THE site")
        if k % 9 == 0:
            lines += ["the the the the # $"] * 3
        if k % 20 == 1:
            lines = [f"Menu {k} of the site and much more " + "that is all " * 20]
        rows.append((k, "\n".join(lines), f"h{k % 3}" if k % 10 else None))
    return rows


def test_quality(documents, awkward):
    rows = [(i, t, None if k % 2 else "h0") for k, (i, t) in enumerate(awkward)] + quality_rows()
    found = quality.assess(documents(rows)).collect()
    got = Counter((r.doc_id, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept"))) for r in found)
    assert got == brute_quality(rows)


def test_quality_filter_removes_common_lines(documents):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits would all be one line to the rule
    rows = [(k, f"same line here\n{' '.join(prose(random.Random(k), 60)).translate(letters)}") for k in range(30)]
    docs = documents(rows)
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {k: t.split("\n")[1] for k, t in rows}
    assert quality.filter_documents(documents([])).collect() == []


def toxic_rows(spark):
    rng = random.Random(8)
    bad = ["Vexorum", "v3x0rum", "vеxorum", "grumbol", "Grumbol###", "snarvik", "snárvik"]
    docs, labels = [], []
    for k in range(900):
        words = prose(rng, rng.randrange(20, 200))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(bad)
        elif k % 50 == 1:
            words[3:5] = ["garden", "snarvik"]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity(spark, documents):
    rows, labels = toxic_rows(spark)
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert any(t.startswith(" vex") or t.startswith(" gru") for t in model["weights"])
    assert "garden snarvik" in model["phrases"]
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, mark in labels:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= found[k].score <= 1 and found[k].predicted == int(found[k].score >= 0.3)
    held = [k for k, _ in labels if found[k].held_out]
    right = sum(found[k].predicted == labels[k][1] for k in held)
    assert right / len(held) > 0.97
    extra = toxicity.score(documents([(None, None), (1, ""), (1, "v3x0rum scum")]), model).collect()
    assert [r.doc_id for r in extra] == [None, 1, 1] and extra[0].score == extra[1].score < extra[2].score


def test_toxicity_without_labels(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1
    assert toxicity.score(documents([]), model).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    rows, labels = toxic_rows(spark)
    flipped = [(k, 1 - m if zlib.crc32(str(k).encode()) % 4 == 2 else m) for k, m in labels]
    a, b = (toxicity.learn(documents(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_matcher_equals_plain_search():
    rng = random.Random(21)
    for _ in range(200):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30))]
        weights = {t: rng.random() + 0.1 for w in words[:6] for t in rng.sample(sorted(toxicity.word_terms(w)), 1)}
        phrases = [" ".join(words[k:k + 2]) for k in range(0, len(words) - 1, 7)]
        text = f" {' '.join(words)} "
        spans = [(k, k + len(p) + 2) for p in phrases for k in range(len(text)) if text.startswith(f" {p} ", k)]
        want = [(k, k + len(t), w) for t, w in weights.items() for k in range(len(text)) if text.startswith(t, k)]
        want = [h for h in want if not any(a <= h[0] and h[1] <= b for a, b in spans)]
        assert sorted(toxicity.Matcher(weights, phrases).hits(text)) == sorted(want)


def test_folding():
    fold = toxicity.folder()
    assert fold("ІDІ0T, 1d1ot! café 2024 $cum").split() == ["idiot", "idiot", "cafe", "scum"]
    assert fold(None).split() == []


def as_sql(docs, module):
    """The operator's rows over ``docs`` are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    found = module.scan(docs)
    want = con.sql(module.ORACLE)
    assert found.columns == want.columns
    assert Counter(map(tuple, found.collect())) == Counter((None if r[0] != r[0] else r[0], *r[1:]) for r in want.fetchall())


def test_licences(documents, awkward):
    british = MIT.replace("sublicense", "sublicence").upper()
    rows = awkward + [
        (20, f"Copyright (c) 2020 Some One\n\n{british}"), (21, BSD_2_CLAUSE.replace("\n", "  \n")), (22, MIT + " and more"),
        (23, "Some prose.\nreleased under the MIT Licence!\nAll rights reserved\nAll Rights Reserved."), (24, "© 2024 Ann"),
    ]
    found = licences.scan(documents(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[20].licence == "MIT" and by_id[21].licence == "BSD-2-Clause" and by_id[22].licence is None
    assert (by_id[23].n_notices, by_id[23].notices) == (3, "MIT all-rights-reserved")
    assert by_id[24].text_digest is None and by_id[2].text_digest is None and by_id[2].notices == ""
    assert licences.scan(documents([])).collect() == []


def test_full_licence_texts_are_known(documents):
    from pathlib import Path

    folder = Path(licences.__file__).parent / "licence_files"
    read = {f.stem.removesuffix(".other"): f.read_text() for f in sorted(folder.glob("*.txt"))}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} == set(read)
    named = sorted(read.items())
    apache = read["Apache-2.0"]
    named += [("Apache-2.0", apache[:apache.index("END OF TERMS")].upper()), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2019 Ann"))]
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    named.append(("BSD-3-Clause", "Copyright (c) 2020 Ann\n\n" + BSD_2_CLAUSE.replace("THIS SOFTWARE IS", f"{third}\n\nTHIS SOFTWARE IS")))
    found = {r.doc_id: r.licence for r in licences.scan(documents(list(enumerate(t for _, t in named)))).collect()}
    assert [found[i] for i in range(len(named))] == [n for n, _ in named]
    lines = [("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("MPL-2.0", "// SPDX-License-Identifier: MPL-2.0"), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    noted = {r.doc_id: r.notices for r in licences.scan(documents([(i, f"prose\n{t}\nprose") for i, (_, t) in enumerate(lines)])).collect()}
    assert noted == {i: n for i, (n, _) in enumerate(lines)}
    digests = [d for d, _ in licences.known_digests()]
    assert len(set(digests)) == len(digests)


def test_copyright_lines_with_and_without_year(documents):
    heads = [
        "Copyright (c) Facebook, Inc. and its affiliates.", "Copyright (c) 2020, X\nAll rights reserved.", "Copyright Joyent, Inc. and other Node contributors.",
        "Copyright 2011-2014 ann <a@b.c>\n\nAll rights reserved.", "// Copyright © The Go Authors\n//\n// All Rights Reserved", "© Ann", "(c) 2020 ann", "(C) Ann Lee, 2020",
        "Copyright [yyyy] [name of copyright owner]", "Copyright (c) 2019 A\r\nCopyright (c) B\r\nAll rights reserved.\r", "COPYRIGHT 2020 ANN. ALL RIGHTS RESERVED",
    ]
    prose = [
        "Copyright law of 1976 protects works.", "Copyright Law of 1976", "copyright notice of 1999", "(c) You must keep the notes of 1998 with it.", "All rights reserved.",
        "COPYRIGHT HOLDERS BE LIABLE FOR 1000 DOLLARS", "\"Copyright\" also means laws of 1998.", "© is a sign since 1952.", "Copyright lasts.\nAll rights reserved.",
    ]
    rows = [(i, f"{h}\n\n{MIT}") for i, h in enumerate(heads)] + [(100 + i, p) for i, p in enumerate(prose)] + [(200, "Copyright (c) X\nAll rights reserved.")]
    found = {r.doc_id: r for r in licences.scan(documents(rows)).collect()}
    assert [h for i, h in enumerate(heads) if found[i].licence != "MIT"] == []
    same = {i: licences.digest(" ".join(licences.NOT_WORD.sub(" ", p.lower()).split())).hex() for i, p in enumerate(prose)}
    spelt = {i: licences.digest(licences.canonical(p, {})).hex() for i, p in enumerate(prose)}
    assert spelt == same and all(found[100 + i].text_digest for i in same)
    assert found[200].text_digest is None and found[200].notices == "all-rights-reserved"
    more = [
        "Copyright (c) A\n--\n•\nAll rights reserved\n•\nx", "Copyright (c) A\n•\nx\nAll rights reserved", "© Ärzte & Söhne, the authors", "Copyright by The Works of Ann",
        "Copyright The Holder", "(c) Ann Lee", "(c) the Ann Lee 2001", "All rights reserved\nCopyright 2020 A\nCopyright 2021 B\n\n* All Rights Reserved *\nAll rights reserved",
        "Copyright Ann <a b> (c d) and x", "Copyright Ann <a b> (c d) and X", "copyright owners of 1990", "É © 2020 x", "COPYRIGHT\u00a0©", "Copyrights: Ann\r", "_ © 1999", "x © 1999",
    ]
    rows += [(300 + i, m) for i, m in enumerate(more)] + [(None, None), (None, MIT), (400, ""), (400, MIT), (400, MIT)]
    as_sql(documents(rows, clashes=False), licences)
