"""Money rules: occupancy prices, child bands, extra adults. All in decimals, rounded half up to cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffmill.functions.base import col, compact_number
from tariffmill.schemas import AGE, MONEY

# Ordinals and labels of child positions.
POSITION_ORDINAL = {"first_child": 1, "second_child": 2, "third_child": 3}
POSITION_LABEL = {"first_child": "1st Child", "second_child": "2nd Child", "third_child": "3rd Child"}
POSITION_PREFIX = {"first_child": "CHD1", "second_child": "CHD2", "third_child": "CHD3"}


def _map_position(position: Column | str, values: dict, default: object = None) -> Column:
    chain = None
    for name, value in values.items():
        test = col(position) == name
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain if default is None else chain.otherwise(default)


def position_ordinal(position: Column | str) -> Column:
    return _map_position(position, POSITION_ORDINAL)


def position_label(position: Column | str) -> Column:
    return _map_position(position, POSITION_LABEL, F.lit("Child"))


def money(c: Column | str) -> Column:
    return col(c).cast(MONEY)


def percent_of(amount: Column, percent: Column) -> Column:
    """``percent`` % of ``amount`` in cents. Multiplying by 0.01 keeps the product an exact decimal."""
    return F.round(amount.cast(MONEY) * percent.cast("decimal(12,4)") * F.lit(0.01).cast("decimal(3,2)"), 2).cast(MONEY)


def classify_band(age_from: Column | str, age_to: Column | str) -> Column:
    """FN14: baby up to 2, teen from 12, child otherwise and when ages are unknown."""
    return F.when(col(age_to) <= 2, "baby").when(col(age_from) >= 12, "teen").otherwise("child")


def band_price(value_type: Column | str, value: Column | str, adult_rate: Column | str) -> Column:
    """FN15: price of a child band. 100 % or more is free even when the adult rate is unknown for discounts."""
    kind, v, adult = col(value_type), col(value), money(adult_rate)
    free = F.lit(0).cast(MONEY)
    return (
        F.when(kind == "amount", money(v))
        .when(kind == "discount_percentage", F.when(v >= 100, free).otherwise(percent_of(adult, F.lit(100) - v)))
        .when(
            (kind == "percentage_of_adult") & adult.isNotNull(),
            F.when(v >= 100, free).otherwise(percent_of(adult, v)),
        )
    )


def adult_rate(dbl: Column | str, sgl: Column | str) -> Column:
    return F.coalesce(money(dbl), money(sgl))


def extra_adult(amount: Column | str, kind: Column | str, dbl: Column | str, sgl: Column | str) -> Column:
    """EX10: a discount becomes the price left after it when the adult rate is known; amounts pass."""
    adult = adult_rate(dbl, sgl)
    discounted = (col(kind) == "discount_percentage") & adult.isNotNull() & col(amount).isNotNull()
    return F.when(F.coalesce(discounted, F.lit(False)), percent_of(adult, F.lit(100) - col(amount))).otherwise(
        money(amount)
    )


def _share(supplement: Column) -> Column:
    return (supplement > 0) & (supplement < 1)


def single_price(base: Column | str, supplement: Column | str) -> Column:
    """EX2: base plus supplement; a supplement between 0 and 1 is a share of the base."""
    b, s = money(base), col(supplement).cast("decimal(12,4)")
    return F.when(_share(s), F.round(b + b * s, 2)).otherwise(F.round(b + s, 2)).cast(MONEY)


def reduced_price(base: Column | str, reduction: Column | str) -> Column:
    """EX2: base minus reduction for the third and fourth adult, same share rule."""
    b, r = money(base), col(reduction).cast("decimal(12,4)")
    return F.when(_share(r), F.round(b - b * r, 2)).otherwise(F.round(b - r, 2)).cast(MONEY)


def occupancy_prices(base: Column | str, sgl: Column | str, tpl: Column | str, qdp: Column | str) -> Column:
    """EX2 as struct(sgl, tpl, qdp)."""
    return F.struct(
        single_price(base, sgl).alias("sgl"), reduced_price(base, tpl).alias("tpl"),
        reduced_price(base, qdp).alias("qdp"),
    )


def child_amount(value_type: Column | str, value: Column | str, dbl: Column | str) -> Column:
    """N5's value: percentages as money of the row's double rate.

    For percentages of the adult rate, up to 5 is a share and up to 100 a percentage. Values out of range, amounts,
    and rows without a double rate pass unchanged.
    """
    kind, v, adult = col(value_type), col(value), money(dbl)
    discount = (kind == "discount_percentage") & v.between(0, 100)
    share = (kind == "percentage_of_adult") & v.between(0, 5)
    percent = (kind == "percentage_of_adult") & (v > 5) & (v <= 100)
    priced = (
        F.when(discount, percent_of(adult, F.lit(100) - v))
        .when(share, F.round(adult * v.cast("decimal(12,4)"), 2).cast(MONEY))
        .when(percent, percent_of(adult, v))
    )
    return F.coalesce(priced, money(v))


def extra_bed_amount(extra_bed: Column | str, is_percent: Column | str, dbl: Column | str) -> Column:
    """A flagged percentage as money of the row's double rate."""
    pct = F.coalesce(col(is_percent), F.lit(False)) & col(extra_bed).between(0, 100)
    return F.coalesce(F.when(pct, percent_of(money(dbl), F.lit(100) - col(extra_bed))), money(extra_bed))


def child_key(position: Column | str, age_from: Column | str, age_to: Column | str) -> Column:
    """FN21: CHD1(2-11.99) and the like; unknown ages print as ?."""
    def age(c: Column | str) -> Column:
        return F.coalesce(compact_number(col(c).cast(AGE)), F.lit("?"))

    prefix = _map_position(position, POSITION_PREFIX, F.lit("CHD"))
    return F.concat(prefix, F.lit("("), age(age_from), F.lit("-"), age(age_to), F.lit(")"))
