"""Licence scan by canonical digests.

A text becomes canonical by lower case, without copyright lines and an "All rights reserved" that follows one, with
punctuation as blanks, equivalent spellings as one, and single spaces. Its digest is joined with the digests of known licences, treated alike. A document is looked up as a
whole, and so is each of its lines, for notices that stand in a longer text. The known digests are a constant of this
package, which bounds their broadcast.

Defined cases: a null text is an empty one; the canonical text of a text without words is empty and matches nothing;
repeated and equal rows are rows of their own; a very long text is read whole in one task; other columns are not read.
The SQL applies the same patterns line by line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.licence_texts import KNOWN, SPELLINGS

# A copyright line is "copyright" with (c), a year or a holder after it, or a sign with a year or holder. A holder is names
# to the end of the line, so that prose such as "Copyright law of 1976 ..." stays. Each form is a head and what follows it;
# for a holder, a head after which a common noun stands is none. The patterns use only what both Python and SQL know.
_YEAR = r"(?:[0-9]{4}|[\[<{(]?(?i:yyyy|year)[\]>})])"
_NO_HOLDER = (
    "Act|Acts|And|Are|As|At|Basics|Claim|Claims|Directive|For|Holder|Holders|In|Information|Infringement|Is|Issues|Law|Laws|License|Licence|"
    "Licenses|Material|Materials|Notice|Notices|Of|Office|On|Or|Owner|Owners|Ownership|Policy|Protection|Reform|Registration|Rights|Statement|"
    "Status|Term|Terms|To|Treaty|Under|Was|With|Work|Works"
)
_OTHER = "À-ÖØ-öø-\u1fff\u2c00-\u2dff\u3005-\ud7ff\uf900-\ufdff"  # letters beyond ASCII
_CAPITAL = f"[A-Z{_OTHER}]"
_GAP = f"[^A-Za-z0-9_{_OTHER}]{{0,8}}"
_NAME = (
    rf"(?:{_CAPITAL}[^ \t\r\n]*|[0-9][^ \t\r\n]*|&|<[^>]*>|\([^)]*\)|(?:a|affiliates|all|and|authors?|by|contributors?|de|developers|individual|its|of|"
    r"others?|present|reserved|rights|subsidiaries|team|the|their|to|van|von)[.,;:]?)"
)
_HOLDER = rf"{_CAPITAL}[^ \t\r\n]*(?:[ \t]+{_NAME})*[ \t\r]*$"
_START = "^[^A-Za-z0-9]*"
PLAIN_FORMS = (
    rf"{_START}(?i:copyrights?){_GAP}(?:(?i:\(c\)|&copy;)|©)",
    rf"{_START}(?i:copyrights?){_GAP}{_YEAR}",
    rf"{_START}(?:(?i:\(c\))|©){_GAP}(?:(?i:copyright)(?:[^A-Za-z0-9_{_OTHER}]|$)|{_YEAR})",
)
HOLDER_HEADS = tuple(
    (head + before, needs) for head, needs in (
        (rf"{_START}[Cc]opyrights?:?[ \t]+", None), (rf"{_START}©[ \t]*", None), (rf"{_START}(?i:\(c\))[ \t]*", rf"{_START}(?i:\(c\)).*[0-9]{{4}}"),
    ) for before in ("", r"by[ \t]+", r"[Tt]he[ \t]+", r"by[ \t]+[Tt]he[ \t]+")
)
_NOUN = rf"(?:{_NO_HOLDER})(?:[^A-Za-z0-9_{_OTHER}]|$)"
RESERVED = rf"^[^A-Za-z0-9{_OTHER}]*(?i:all[ \t]+rights[ \t]+reserved)[^A-Za-z0-9{_OTHER}]*$"
SOLID = f"[A-Za-z0-9{_OTHER}]"
_PLAIN = re.compile("|".join(PLAIN_FORMS))
_HOLDERS = [(re.compile(head + _HOLDER), re.compile(head + _NOUN), re.compile(needs or "")) for head, needs in HOLDER_HEADS]
_RESERVED, _SOLID, _SIGN = re.compile(RESERVED), re.compile(SOLID), re.compile(r"(?i:copyright|\(c\))|©")
NOT_WORD = re.compile("[^a-z0-9\x80-\U0010ffff]+|[‘’“”–—©]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_copyright(line: str) -> bool:
    if not _SIGN.search(line):
        return False
    return bool(_PLAIN.search(line)) or any(
        holder.search(line) and not noun.search(line) and needs.search(line) for holder, noun, needs in _HOLDERS
    )


def without_copyright(text: str) -> str:
    """The text's lines but copyright lines and an "All rights reserved" that follows one, with signs only between them."""
    kept: list[str] = []
    after, between = False, 0  # whether the last line with letters was a copyright line; lines kept since
    for line in text.split("\n"):
        if is_copyright(line):
            after, between = True, 0
        elif not _SOLID.search(line):
            kept.append(line)
            between += 1
        elif after and _RESERVED.search(line):
            del kept[len(kept) - between:]
            after, between = False, 0
        else:
            kept.append(line)
            after, between = False, 0
    return "\n".join(kept)


def canonical(text: str | None, spellings: dict[str, str]) -> str:
    plain = text or ""
    if _SIGN.search(plain):
        plain = without_copyright(plain)
    return " ".join(spellings.get(w, w) for w in NOT_WORD.sub(" ", plain.translate(UPPER)).split(" ") if w)


def digest(canonical_text: str) -> bytes:
    return hashlib.sha256(canonical_text.encode()).digest()


def known_digests(known: Sequence[tuple[str, str]] = KNOWN, spellings: Sequence[tuple[str, str]] = SPELLINGS) -> list[tuple[bytes, str]]:
    return sorted({(digest(canonical(text, dict(spellings))), name) for name, text in known})


def _units(pairs: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = dict(pairs)
        for batch in batches:
            whole, lines = [], []
            for text in batch.column("text").to_pylist():
                own = canonical(text, spellings)
                whole.append(digest(own) if own else None)
                parts = (canonical(line, spellings) for line in (text or "").split("\n"))
                lines.append([digest(p) for p in parts if p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(whole, pa.binary()), pa.array(lines, pa.list_(pa.binary()))],
                ["row", "doc_id", "text_digest", "line_digests"],
            )

    return run


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, spellings: Sequence[tuple[str, str]] = SPELLINGS) -> DataFrame:
    """doc_id, text_digest (hexadecimal; null without words), licence (of the whole text), n_notices, notices (sorted,
    distinct, joined by a blank).

    One pass over the texts. Only rows with a line that a known digest meets go through the second join's exchange.
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(known_digests(known, spellings), "digest binary, licence string"))
    texts = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    id_type = texts.schema["doc_id"].dataType.simpleString()
    units = texts.mapInArrow(_units(spellings), f"row long, doc_id {id_type}, text_digest binary, line_digests array<binary>")
    names = F.sort_array(F.collect_set("licence"))
    looked = units.join(table.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    lined = looked.select("row", "doc_id", "text_digest", F.col("licence").alias("whole"), F.explode_outer("line_digests").alias("digest")).join(table, "digest", "left")
    found = lined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_digest").alias("text_digest"), F.first("whole").alias("licence"),
        F.count("licence").alias("n_notices"), names.alias("names"),
    )
    return found.select("doc_id", F.lower(F.hex("text_digest")).alias("text_digest"), "licence", "n_notices", F.array_join("names", " ").alias("notices"))


def _sql() -> str:
    known = ", ".join(f"('{d.hex()}', '{name}')" for d, name in known_digests())
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS)

    def has(pattern: str) -> str:
        return f"regexp_matches(line, '{pattern}')"

    def canon(column: str) -> str:
        lowered = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        spaced = f"regexp_replace({lowered}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+|[‘’“”–—©]+', ' ', 'g')"
        return f"array_to_string(list_transform(list_filter(string_split({spaced}, ' '), lambda w: w <> ''), lambda w: coalesce(spell[w], w)), ' ')"

    forms = [has(p) for p in PLAIN_FORMS] + [
        f"({has(head + _HOLDER)} AND NOT {has(head + _NOUN)}" + (f" AND {has(needs)})" if needs else ")") for head, needs in HOLDER_HEADS
    ]
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(digest, licence)),
d AS (SELECT row_number() OVER () AS n_row, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT n_row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
f AS (SELECT *, {has("(?i:copyright|\\(c\\))|©")} AND ({" OR ".join(forms)}) AS own, {has(SOLID)} AS solid, {has(RESERVED)} AS reserved FROM e),
s AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY n_row ORDER BY pos), false) AND reserved AND NOT own AS follows FROM f WHERE solid OR own),
t AS (SELECT f.*, coalesce(s.follows, false) AS follows FROM f LEFT JOIN s USING (n_row, pos)),
g AS (SELECT n_row, pos, line, own, follows, NOT (solid OR own) AND coalesce(
    first_value(CASE WHEN solid OR own THEN follows END IGNORE NULLS) OVER (PARTITION BY n_row ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS between_them FROM t),
h AS (SELECT n_row, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT own AND NOT follows AND NOT between_them), '') AS text FROM g GROUP BY n_row),
spelt AS (SELECT MAP {{{pairs}}} AS spell),
w AS (SELECT n_row, {canon('text')} AS own FROM h, spelt),
l AS (SELECT n_row, {canon('line')} AS own FROM g, spelt WHERE NOT g.own),
n AS (SELECT n_row, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT licence)), ' ') AS notices FROM l JOIN known ON digest = sha256(own) WHERE own <> '' GROUP BY n_row)
SELECT doc_id, CASE WHEN own <> '' THEN sha256(own) END AS text_digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM d JOIN w USING (n_row) LEFT JOIN known ON digest = sha256(own) AND own <> '' LEFT JOIN n USING (n_row)
"""


ORACLE = _sql()
