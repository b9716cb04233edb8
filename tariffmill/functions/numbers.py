"""Numbers out of contract text. The three comma rules differ on purpose and must stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffmill.functions.base import cases, col, compact_number, once, squeezed
from tariffmill.schemas import MONEY, NUMBER

_PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$"

# Words that stand for no value, and words that stand for "free".
NO_VALUE_WORDS = ("N/A", "NA", "-", "NULL", "UNDEFINED", "NONE")
FREE_WORDS = ("FREE", "FOC", "INCLUDED")

# Words a sheet cell may hold instead of a number, and instead of a price.
SHEET_WORDS = ("N/A", "NA", "-", "FREE", "FOC", "NULL", "INCLUDED")

# What counts as a price, and the patterns of currencies and of dates or periods in a price cell.
LOWEST_PRICE, HIGHEST_PRICE, LONGEST_PRICE_TEXT = 5, 50000, 80
CURRENCY_PATTERN = r"(?i)\b(EUR|EURO|USD|US\$|GBP|AED|EGP)\b|[€$£]"
DATE_OR_PERIOD_PATTERN = (
    r"\b\d{1,2}\s*[/-]\s*\d{1,2}(?:\s*[/-]\s*\d{2,4})?\b"
    r"|\b\d{1,2}\s*\.\s*\d{1,2}\s*\.\s*\d{2,4}\b"
    r"|\b\d{1,2}\s*\.\s*\d{1,2}\s*-\s*\d{1,2}\s*\.\s*\d{1,2}\b"
)


def parse_plain(text: Column) -> Column:
    """Decimal from plain number text, null for anything else."""
    return F.when(text.rlike(_PLAIN), text.try_cast(NUMBER))


def _digits(text: Column) -> Column:
    """The number of text that is digits and points only, read without a pattern; most values are, and patterns are dear."""
    return F.when(F.translate(text, "0123456789.", "") == "", text.try_cast(NUMBER))


def _is_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(?i)^(" + "|".join(words) + ")$")


def read_number(text: Column, integer: bool = False, free: Column | None = None) -> Column:
    """FN7's number for stripped text: percentages lose sign and mark, commas are thousands marks, 'free' is ``free``."""
    percent = F.when(text.endswith("%"), parse_plain(F.btrim(F.regexp_replace(text, r"%+$|^-+(?=.*%$)", ""))))
    plain = parse_plain(F.translate(text, ", ", ""))
    gratis = F.when(_is_word(text, FREE_WORDS), (F.lit(0) if free is None else free).cast(NUMBER))
    digits = _digits(text)
    if integer:
        digits, plain = _truncated(digits), _truncated(plain)
    return F.coalesce(digits, percent, plain, gratis)


def unread_text(text: Column, number: Column) -> Column:
    """FN7's prose: stripped text that gave no number and does not say 'no value'."""
    return F.when(text.isNotNull() & number.isNull() & ~_is_word(text, NO_VALUE_WORDS), text)


def free_value(value_type: Column) -> Column:
    """What 'free' means: all of a discount, nothing of an amount."""
    return F.when(value_type == "discount_percentage", 100).otherwise(0)


def coerce_number(value: Column | str, integer: bool = False, value_type: Column | None = None) -> Column:
    """FN7: struct(num, prose). Text that is no number becomes prose."""
    text = squeezed(value)
    number = read_number(text, integer, None if value_type is None else free_value(value_type))
    return F.struct(number.alias("num"), unread_text(text, number).alias("prose"))


def _truncated(number: Column) -> Column:
    whole = F.floor(F.abs(number))
    return F.when(number < 0, -whole).otherwise(whole).cast(NUMBER)


def to_float(value: Column | str) -> Column:
    """FN8: sheet cell text as a number. A comma is a decimal mark; one trailing % is dropped."""
    s = squeezed(value)
    cleaned = F.btrim(F.regexp_replace(F.btrim(F.translate(s, ",€$", ".")), "%$", ""))
    return F.coalesce(_digits(s), F.when(~_is_word(s, SHEET_WORDS), parse_plain(cleaned)))


def to_int(value: Column | str) -> Column:
    """Whole part of ``to_float``."""
    return _truncated(to_float(value)).try_cast("int")


def parse_price_cell(text: Column | str, number: Column | str | None = None) -> Column:
    """FN9: price of a source cell, or null when the cell holds none."""
    known = None if number is None else col(number).try_cast(MONEY)
    price = once(squeezed(text), lambda s: _price(s) if known is None else F.coalesce(known, _price(s)))
    return once(price, lambda p: F.when(F.abs(p).between(LOWEST_PRICE, HIGHEST_PRICE), p))


def _price(s: Column) -> Column:
    """The price that stripped cell text spells, of any size."""
    cleaned = F.regexp_replace(F.regexp_replace(s, CURRENCY_PATTERN, "").transform(_comma_to_dot), r"\s+", "")
    # The character test is cheap and turns most cells away before the patterns are tried.
    looks_like_price = (
        (F.length(s) <= LONGEST_PRICE_TEXT)
        & s.rlike(r"^[-\d.,\s€$£EURODSGBPAeurodsgbpa]*\d[-\d.,\s€$£EURODSGBPAeurodsgbpa]*$")
        & ~s.rlike(DATE_OR_PERIOD_PATTERN)
    )
    # A bare number holds no currency, date or period, so one short pattern settles it.
    return F.when(s.rlike(r"^\d{1,5}(\.\d{1,2})?$"), s.try_cast(MONEY)).when(
        looks_like_price, once(cleaned, lambda c: F.when(c.rlike(r"^-?\d{1,5}(\.\d{1,2})?$"), c.try_cast(MONEY)))
    )


def _comma_to_dot(c: Column) -> Column:
    return F.translate(c, ",", ".")


def format_cost(value: Column | str, cost_format: Column | str) -> Column:
    """FN23: '50%' or '12.5%' for percentages, the plain number otherwise."""
    text = compact_number(value)
    return F.when(col(cost_format) == "percentage", F.concat(text, F.lit("%"))).otherwise(col(value).cast("string"))
