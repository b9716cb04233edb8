"""Small building blocks shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (col(c) == "")


def first_filled(*cs: Column | str) -> Column:
    """The first column that is neither null nor ''."""
    return F.coalesce(*[blank(c) for c in cs])


WHITESPACE = " \t\n\r\f\v"


def stripped(c: Column | str) -> Column:
    """Text without surrounding whitespace of any kind."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def squeezed(c: Column | str) -> Column:
    """Stripped text, or null when nothing is left."""
    return blank(stripped(c))


def any_contains(c: Column, needles: Iterable[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def count_contained(c: Column, needles: Iterable[str]) -> Column:
    """How many of the needles occur in the text."""
    total = F.lit(0)
    for needle in needles:
        total = total + c.contains(needle).cast("int")
    return total


def cases(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """``when`` chain from (condition, value) pairs in order."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def norm_label(c: Column | str) -> Column:
    """Lower case, whitespace collapsed, trimmed; null counts as empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Trimmed lower case; null counts as empty."""
    return F.lower(stripped(F.coalesce(col(c), F.lit(""))))


def compact_number(c: Column | str) -> Column:
    """Decimal as text without trailing zeros: 2.00 -> 2, 11.90 -> 11.9."""
    text = col(c).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often ``use`` names it.

    Spark repeats an expression wherever it is named below a condition, patterns included.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
