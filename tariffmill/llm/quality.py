"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z in lower case, runs of digits to one 0, runs of blanks to one space) and hashed. For each host,
the distinct documents holding a line are counted; copies of a text count as one document, so that a page copied often
does not turn its own lines into boilerplate. Lines in more than ``floor`` documents and more than ``percent`` of a
host's documents are removed, and documents that lose more than half of their words are rejected, as are those that fail
the base rules.

Defined cases: a null text is an empty one (no words, so the base rules fail); a null host is a host of its own; repeated
rows are copies; columns of other names pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import BLANK_RUN, Workspace, free_name, text_or_empty, trimmed, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def normal_line(line: Column) -> Column:
    lowered = F.translate(line, UPPER, LOWER)
    return trimmed(F.regexp_replace(F.regexp_replace(lowered, BLANK_RUN, " "), "[0-9]+", "0"))


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(normal_line(line)))


def common_lines(docs: DataFrame, host: str = "source", floor: int = 5, percent: int = 5) -> DataFrame:
    """(host, heavy): hashes of a host's lines above the limits; hosts without such lines are left out.

    Every row that leaves a scan task is a line of a document; a line is counted once for each text by a first
    aggregate on (host, line, text) and then by (host, line), both with partial steps, so a host or line that holds a
    third of all rows is summed before it is exchanged. A host has at most (lines per document) * 100 / percent such
    lines, which bounds the collected list whatever the host's size.
    """
    text = text_or_empty()
    lined = docs.select(
        F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"),
        F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "").alias("lines"),
    )
    lines = lined.select("host", "text_hash", F.explode(F.array_distinct(_line_hashes(F.col("lines")))).alias("line"))
    per_line = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash")).distinct().groupBy(
        "host"
    ).agg(F.count(F.lit(1)).alias("host_docs"))
    often = per_line.where(F.col("n_docs") > floor)
    over = often.join(sizes.withColumnRenamed("host", "h"), often["host"].eqNullSafe(F.col("h"))).where(
        F.col("n_docs") * 100 > F.col("host_docs") * percent
    )
    return over.groupBy("host").agg(F.collect_set("line").alias("heavy"))


def _repeated_words(hashes: Column, ordered: Column) -> Column:
    """Words in 3-word windows whose hash stands twice or more in ``ordered`` (hash, place), sorted."""
    def twin(e: Column, k: Column) -> Column:
        before, after = F.get(ordered, k - 1)["h"], F.get(ordered, k + 1)["h"]
        return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

    places = F.transform(F.filter(ordered, twin), lambda e: e["i"])
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))
    return F.size(covered).cast("long")


def assess(docs: DataFrame, host: str = "source", floor: int = 5, percent: int = 5) -> DataFrame:
    """All columns of ``docs`` plus the base counts, ``base_failed``, ``words_left``, ``kept`` and ``clean_text``.

    Two scans and no exchange of texts: the first finds each host's common lines, the second meets them in a join on the
    host. That table is one row a host; Spark broadcasts it when its written size is below its threshold and otherwise
    joins by exchange, where adaptive execution splits a host with a third of all rows.
    """
    work = Workspace(docs.sparkSession, "quality")
    heavy = work.save(common_lines(docs, host, floor, percent), "lines")
    work.release()
    plain = docs.drop(*[c for c in docs.columns if c in RESULTS or c == "clean_text"])
    n = free_name(plain, "q_text", "q_words", "q_lines", "q_hashes", "q_windows", "q_ordered", "q_host", "q_heavy")
    text, word, line, hashes, windows, ordered = (F.col(n[k]) for k in ("q_text", "q_words", "q_lines", "q_hashes", "q_windows", "q_ordered"))
    heavy = heavy.select(F.col("host").alias(n["q_host"]), F.col("heavy").alias(n["q_heavy"]))
    joined = plain.join(heavy, plain[host].cast("string").eqNullSafe(heavy[n["q_host"]]), "left").drop(n["q_host"])
    split = joined.withColumn(n["q_text"], text_or_empty()).withColumns({n["q_words"]: words(text), n["q_lines"]: F.split(text, "\n")})
    counted = split.withColumns({
        "n_words": F.size(word).cast("long"),
        "word_chars": F.length(F.array_join(word, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        n["q_hashes"]: _line_hashes(line),
        n["q_windows"]: F.when(F.size(word) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))
        )).otherwise(F.array().cast("array<bigint>")),
    })
    repeats = counted.withColumn(n["q_ordered"], F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    filled = F.filter(line, lambda x: trimmed(x) != "")
    removed = F.coalesce(F.arrays_overlap(hashes, F.col(n["q_heavy"])), F.lit(False))
    left = F.filter(line, lambda x, i: ~F.array_contains(F.col(n["q_heavy"]), F.get(hashes, i)))
    out = repeats.withColumns({
        "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
        "n_repeat_words": F.when(ordered.isNull(), F.lit(0).cast("long")).otherwise(_repeated_words(windows, ordered)),
        "clean_text": F.when(removed, F.array_join(left, "\n")).otherwise(text),
    })
    judged = out.withColumns({
        "words_left": F.when(removed, F.size(words(F.col("clean_text"))).cast("long")).otherwise(F.col("n_words")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    })
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") * 2 >= F.col("n_words"))).drop(*n.values())


def filter_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept documents with their common lines removed, in the columns of ``docs``; ``n_chars`` follows the text.

    Verdicts are written before rows are dropped: a filter on ``kept`` would be pushed below the steps that compute it,
    and each lambda in them would compute its arrays anew for every word.
    """
    work = Workspace(docs.sparkSession, "quality-rows")
    others = [c for c in docs.columns if c != "text"]
    narrow = docs.select(F.struct(*others).alias("__row"), "text", F.col(host).alias("__host"))
    kept = work.save(assess(narrow, "__host").select("__row", "clean_text", "kept"), "judged").where("kept")
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[(new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
filled AS (
    SELECT *, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm,
        len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS line_words
    FROM lines
),
per_line AS (SELECT source, norm, count(DISTINCT text) AS n_docs FROM filled WHERE line_words > 0 GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY ALL),
heavy AS (
    SELECT p.source, p.norm FROM per_line p JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source
    WHERE n_docs > 5 AND n_docs * 100 > host_docs * 5
),
lost AS (
    SELECT doc_id, sum(line_words) AS lost_words FROM filled f
    WHERE EXISTS (SELECT 1 FROM heavy h WHERE h.source IS NOT DISTINCT FROM f.source AND h.norm = f.norm) GROUP BY ALL
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM filled WHERE line_words > 0 GROUP BY ALL),
win AS (
    SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS trio
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, trio) AS c FROM win) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL),
counts AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
    FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, n_words - lost_words AS words_left,
    NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND (n_words - lost_words) * 2 >= n_words AS kept
FROM counts
"""
