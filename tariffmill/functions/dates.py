"""Dates stay ISO strings, as the contract model has them; they become real dates only to be checked or counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffmill.functions.base import any_contains, blank, col, once, squeezed

_ISO_PREFIX = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
_DAY_FIRST = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"
_DAY_FIRST_SAME_MARK = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{2,4})$"

ALL_WEEK = "1234567"


def _padded(date: Column) -> Column:
    return F.regexp_replace(date, r"-(\d)(?!\d)", "-0$1")


def _from_iso(text: Column) -> Column:
    return _padded(F.regexp_extract(text, _ISO_PREFIX, 0))


def _is_full_iso(text: Column) -> Column:
    """True for text that starts with an ISO date of ten characters, which needs no padding; most dates do."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}")


def _from_day_first(text: Column, pattern: str, order: str) -> Column:
    turned = F.regexp_replace(F.regexp_replace(text, pattern, order), r"^(\d\d)-", "20$1-")
    return _padded(F.regexp_replace(turned, r"^(\d{3})-", "0$1-"))


def normalize_iso_date(c: Column | str) -> Column:
    """FN5: ISO text from an ISO prefix or a day-first date. The calendar is not checked here."""
    return iso_date_of(squeezed(c))


def iso_date_of(s: Column) -> Column:
    """FN5 for stripped text. Keep it in a column of its own: each rule names it again."""
    return (
        F.when(_is_full_iso(s), F.substring(s, 1, 10))
        .when(s.rlike(_ISO_PREFIX), _from_iso(s))
        .when(s.rlike(_DAY_FIRST), _from_day_first(s, _DAY_FIRST, "$3-$2-$1"))
    )


def to_iso_date_strict(c: Column | str) -> Column:
    """FN6: as above, but both separators must agree and the day must exist."""
    text = once(squeezed(c), lambda s: (
        F.when(s.rlike(_ISO_PREFIX), _from_iso(s))
        .when(s.rlike(_DAY_FIRST_SAME_MARK), _from_day_first(s, _DAY_FIRST_SAME_MARK, "$4-$3-$1"))
    ))
    return once(text, lambda d: F.when(real_date(d).isNotNull(), d))


def real_date(iso: Column | str) -> Column:
    """The calendar date of an ISO text, null when there is no such day."""
    return F.when(col(iso).rlike(r"^\d{4}-\d{2}-\d{2}\z"), col(iso).try_cast("date"))


def format_day_first(c: Column | str) -> Column:
    """FN11: YYYY-MM-DD to DD-MM-YYYY; any other shape passes unchanged."""
    return F.regexp_replace(blank(c), r"^([^-]{4})-([^-]{2})-([^-]{2})$", "$3-$2-$1")


def days_inclusive(start: Column | str, end: Column | str) -> Column:
    """FN12: nights plus one; null when either text is no calendar date."""
    return F.datediff(real_date(end), real_date(start)) + 1


def days_mask(c: Column | str) -> Column:
    """FN10: weekday mask as ascending digits 1-7, where 0 (Sunday) becomes 7."""
    return mask_of(squeezed(c))


def mask_of(s: Column) -> Column:
    """FN10 for stripped text. Keep it in a column of its own: each rule names it again."""
    ranged = r"^(\d)\s*(?:[tT][oO]|-|–)\s*(\d)$"
    # A stripped range begins and ends with its two digits.
    low, high = F.substring(s, 1, 1).try_cast("int"), F.substring(s, -1, 1).try_cast("int")
    span = F.substring(F.lit("0123456789"), F.least(low, high) + 1, F.abs(high - low) + 1)
    digits = F.when(s.rlike(r"^[1-7]+$"), s).when(s.rlike(ranged), span).otherwise(F.regexp_replace(s, "[^0-6]", ""))

    def ascending(d: Column) -> Column:
        mask = F.concat(*[
            F.when(d.contains(str(n)) | d.contains("0") if n == 7 else d.contains(str(n)), str(n)).otherwise("") for n in range(1, 10)
        ])
        return F.when(d.rlike("[0-9]"), mask).otherwise(ALL_WEEK)

    return once(digits, ascending)


def repair_end_date(start: Column | str, end: Column | str) -> Column:
    """N2's value: the end moved into the start's year when a typed year put it before the start, else null.

    ISO texts are compared as text, as the contract model does.
    """
    s, e = col(start), col(end)
    moved = F.concat(F.substring(s, 1, 4), F.substring(e, 5, 6))
    wrong_year = (s > e) & (F.substring(e, 1, 4) < F.substring(s, 1, 4)) & (moved > s)
    return F.when(wrong_year, moved)


def mentions_date(c: Column | str) -> Column:
    """True for text that carries a full date."""
    return col(c).rlike(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}")


def mentions_date_or_month(c: Column | str) -> Column:
    """True for text with a day-first date or an English month name."""
    months = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    return col(c).rlike(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}") | F.lower(col(c)).rlike(rf"(?U)\b({months})")


def date_list(text: Column | str) -> Column:
    """All calendar dates in the text as ISO, day-first ones before ISO ones, each in order of appearance.

    The patterns look for a digit first, so that other characters cost one test.
    """
    t = F.coalesce(col(text), F.lit(""))
    day_first = F.regexp_extract_all(t, F.lit(r"(?=\d)(?<!\d)\d{1,2}([./-])\d{1,2}\1\d{2,4}(?!\d)"), F.lit(0))
    iso = F.regexp_extract_all(t, F.lit(r"(?=\d)(?<!\d)\d{4}-\d{1,2}-\d{1,2}(?!\d)"), F.lit(0))
    return F.filter(F.transform(F.concat(day_first, iso), to_iso_date_strict), lambda d: d.isNotNull())


def date_pairs(text: Column | str) -> Column:
    """W12's value: dates paired 1-2, 3-4 and so on; an odd last date is dropped."""
    dates = date_list(text)
    pairs = F.floor(F.size(dates) / 2).cast("int")
    return F.when(pairs > 0, F.transform(
        F.sequence(F.lit(0), pairs - 1),
        lambda i: F.struct(
            F.get(dates, i * 2).alias("start_date"), F.get(dates, i * 2 + 1).alias("end_date")
        ),
    )).otherwise(F.array().cast("array<struct<start_date:string,end_date:string>>"))


def names_board(c: Column | str) -> Column:
    """The board code a cell consists of, if it is one."""
    s = F.upper(squeezed(c))
    return F.when(s.isin("BB", "HB", "FB", "AI", "RO", "UAI"), s)


def names_room(c: Column | str) -> Column:
    """True for text that reads like a room column."""
    # Words of room columns.
    words = ("single", "double", "twin", "triple", "quad", "suite", "superior", "deluxe", "family", "studio",
             "bungalow", "villa", "room")
    s = F.lower(squeezed(c))
    return F.coalesce((F.length(s) >= 3) & any_contains(s, words), F.lit(False))
