"""Hotel codes, slugs, room names, sheet names and page hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, col, fold

# Words that say nothing about a room, and short forms with what they stand for.
ROOM_NOISE = ("room", "rooms", "type", "view", "couple", "only", "side", "the", "a", "an", "&")
ROOM_SHORT_FORMS = {
    "sup": "superior",
    "dlx": "deluxe",
    "jun": "junior",
    "fam": "family",
    "gv": "gardenview",
    "sv": "seaview",
    "ssv": "seasideview",
    "bf": "beachfront",
    "pv": "poolview",
}

# Sheet names that are covers or lists rather than hotels.
INDEX_SHEET_PATTERN = (
    r"(?i)^\s*(hotel\s*list|hotels|index|summary|contents|table\s+of\s+contents|toc|overview|cover|legend|key|info"
    r"|info\s*page|notes|terms|glossary|master|masterdata|sheet\d+)\s*$"
)

AI_MARK = "[AI] "


def hotel_code(name: Column | str, code: Column | str | None = None) -> Column:
    """FN13: the given code, else six base-36 digits from the name's md5; 000000 for a blank name."""
    folded = fold(name)
    number = F.conv(F.substring(F.md5(folded), 1, 8), 16, 10).cast("bigint") % 36**6
    made = F.when(folded == "", "000000").otherwise(F.lpad(F.conv(number.cast("string"), 10, 36), 6, "0"))
    return made if code is None else F.coalesce(blank(code), made)


def slugify(name: Column | str) -> Column:
    """FN24."""
    dashed = F.regexp_replace(F.lower(F.btrim(col(name))), "[^a-zA-Z0-9]+", "-")
    return F.coalesce(blank(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit("unknown-supplier"))


def room_tokens(name: Column | str) -> Column:
    """FN22: distinct meaningful words of a room name, short forms spelled out."""
    short_forms = F.create_map(*[F.lit(x) for pair in ROOM_SHORT_FORMS.items() for x in pair])
    words = F.filter(
        F.split(F.lower(F.btrim(F.coalesce(col(name), F.lit("")))), r"[\s/_\-().,]+"),
        lambda w: (w != "") & ~w.isin(*ROOM_NOISE),
    )
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(short_forms, w), w)))


def room_match_score(room: Column | str, listed: Column | str) -> Column:
    """J6's score: 999 for equal names, 100 when one contains the other, else 10 per shared word; 0 is no match."""
    r, e = fold(room), fold(listed)
    shared = 10 * F.size(F.array_intersect(room_tokens(room), room_tokens(listed)))
    inside = F.when(r.contains(e) | e.contains(r), 100).otherwise(0)
    return F.when((r == "") | (e == ""), 0).when(r == e, 999).otherwise(F.greatest(shared, inside))


def without_ai_mark(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\[AI\] ", "")


def has_ai_mark(c: Column | str) -> Column:
    return F.coalesce(col(c).startswith(AI_MARK), F.lit(False))


def is_index_sheet(name: Column | str) -> Column:
    """FN30."""
    return F.coalesce(col(name).rlike(INDEX_SHEET_PATTERN), F.lit(False))


def alnum_key(c: Column | str) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def page_numbers(hint: Column | str, page_count: Column | str) -> Column:
    """FN29: pages named by a hint such as '1-3, 5', inside the document, each once; all pages when none is named."""
    n = col(page_count).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def span(low: Column, high: Column) -> Column:
        first, last = F.greatest(F.least(low, high), F.lit(1)), F.least(F.greatest(low, high), n)
        return F.when(first <= last, F.sequence(first, last)).otherwise(empty)

    def pages(token: Column) -> Column:
        ends = F.transform(F.split(token, r"\s*-\s*"), lambda p: p.try_cast("bigint"))
        return F.coalesce(span(F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))), empty)

    tokens = F.regexp_extract_all(F.coalesce(col(hint), F.lit("")), F.lit(r"\d+\s*-\s*\d+|\d+"), F.lit(0))
    named = F.array_distinct(F.flatten(F.transform(tokens, pages)))
    every = F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(empty)
    return F.when(F.size(named) > 0, named).otherwise(every)


def detect_child_keys(text: Column | str) -> Column:
    """FN20's value: distinct CHD(a-b) keys of the text in order of appearance."""
    found = F.regexp_extract_all(
        F.coalesce(col(text), F.lit("")),
        F.lit(r"(?i)CHD\s*\(?\s*\d+(?:\.\d+)?\s*[-–to]+\s*\d+(?:\.\d+)?"), F.lit(0),
    )

    def key(match: Column) -> Column:
        ages = F.regexp_extract_all(match, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
        low, high = F.get(ages, F.lit(0)), F.get(ages, F.lit(1))
        return F.concat(F.lit("CHD("), _short(low), F.lit("-"), _short(high), F.lit(")"))

    return F.array_distinct(F.transform(found, key))


def _short(age: Column) -> Column:
    text = age.try_cast("decimal(10,5)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def mentions_child(text: Column | str) -> Column:
    """True when the text speaks of children without giving ages."""
    return F.coalesce(col(text).rlike(r"(?iU)\b(CHD|CHILD|INFANT|BABY|TEEN|JUNIOR)\b"), F.lit(False))


def is_scrambled(text: Column | str) -> Column:
    """FN26: more than 35 % of at least 30 words are one or two letters or digits long."""
    words = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]{1,2}$")))
    enough = (F.length(col(text)) >= 80) & (F.size(words) >= 30)
    return F.coalesce(enough & (short * 100 > F.size(words) * 35), F.lit(False))


def file_kind(path: Column | str, head: Column | str) -> Column:
    """SRC1's kind: by leading bytes, then by extension; zip files need an office extension to count."""
    magic = F.hex(F.substring(col(head), 1, 8))
    extension = F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))
    # Leading bytes of each kind, and extensions.
    zip_kind = F.when(extension.isin(".xlsx", ".xlsm"), "xlsx").when(extension == ".docx", "docx")
    by_extension = (
        F.when(extension.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff"), "image")
        .when(extension == ".pdf", "pdf")
        .when(extension == ".docx", "docx")
        .when(extension.isin(".xlsx", ".xlsm"), "xlsx")
        .when(extension == ".xls", "xls")
        .otherwise("unknown")
    )
    by_magic = (
        F.when(magic.startswith("25504446"), "pdf")
        .when(magic.startswith("504B0304"), zip_kind)
        .when(magic.startswith("D0CF11E0"), "xls")
        .when(
            magic.startswith("89504E47") | magic.startswith("FFD8FF")
            | magic.startswith("49492A00") | magic.startswith("4D4D002A"),
            "image",
        )
    )
    return F.coalesce(by_magic, by_extension)


