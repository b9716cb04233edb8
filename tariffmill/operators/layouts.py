"""The three export layouts of gen-1 rows: adult/child columns, pax columns, and the three child positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import any_contains, blank, first_filled
from tariffmill.functions.dates import days_mask, real_date
from tariffmill.functions.vocabulary import rate_type_of_layout
from tariffmill.operators.child_columns import BANDS, band_assignment, position_assignment
from tariffmill.schemas import GEO_FIELDS, MONEY

# Rate columns of the two layouts, in order, as column name and printed header.
ADULT_CHILD_HEADERS = {
    "adult_1": "Adult 1 (SGL)",
    "adult_2": "Adult 2 (DBL)",
    "adult_3": "Adult 3 (TPL)",
    "adult_4": "Adult 4 (QUD)",
    "baby_1": "Baby 1 (0-1)",
    "child_1": "Child 1 (2-12)",
    "teen_1": "Teen 1 (12-17)",
    "extra_adult": "Extra Adult",
    "multi_infant": "Multi Infant (0-1)",
    "extra_child": "Extra Child (2-12)",
    "extra_teen": "Extra Teen (12-17)",
}
PAX_HEADERS = {
    "pax_1": "1 Pax",
    "pax_2": "2 Pax",
    "pax_3": "3 Pax",
    "pax_4": "4 Pax",
    "pax_5": "5 Pax",
    "extra_adult": "Extra Adult",
    "multi_infant": "Multi Infant (0-1)",
    "extra_child": "Extra Child (2-12)",
    "extra_teen": "Extra Teen (12-17)",
}
POSITION_HEADERS = {
    f"child_{n}_{part}": f"{ordinal} Child {title}"
    for n, ordinal in ((1, "1st"), (2, "2nd"), (3, "3rd"))
    for part, title in (("price", "Price"), ("age_min", "Age Min"), ("age_max", "Age Max"))
}

# Text columns of an export row and the row field each is read from.
TEXT_COLUMNS = {
    "hotel": "hotel", "hotel_code": "hotel_code", "sell_channel": "sell_channel", "supplier": "supplier",
    "star_rating": "star_rating", "short_description": "short_description", "bed_type": "bed_type",
    "address_line_1": "address_line_1", "address_line_2": "address_line_2", "address_line_3": "address_line_3",
    "address_line_4": "address_line_4", "postal_code": "postal_code", "country_code": "country_code",
    "state_region": "state_region", "city_area": "city_area", "phone": "phone", "email": "email", "website": "website",
    "room": "room", "season": "season", "rate_plan": "rate_plan", "meal_plan": "meal_plan",
}
NUMBER_COLUMNS = (
    "max_rollaways", "max_cribs", "latitude", "longitude", "min_adult", "max_adult", "max_pax", "min_stay",
    "booking_limit", "release_period", "add_charge_value",
)
# What an export row says when the row itself says nothing.
EXPORT_DEFAULTS = {
    "check_in": "00:00", "check_out": "00:00", "status": "Open", "add_charge_type": "Fixed", "charge": "Mark Up",
}


def dominant_layout(rows: DataFrame) -> DataFrame:
    """AG1: each contract's layout from its most frequent rate type; the first seen on a tie, ppn when it has none."""
    counts = rows.groupBy("contract_id", F.lower(F.btrim(F.coalesce("rate_type", F.lit("")))).alias("_type")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first")
    )
    order = F.when(F.col("_type") != "", F.struct("_n", -F.col("_first")))
    top = counts.groupBy("contract_id").agg(F.max_by("_type", order).alias("rate_type"))
    per_room = any_contains(F.col("rate_type"), ("per room", "per-room"))
    return top.withColumn(
        "layout",
        F.when(per_room & F.col("rate_type").contains("pax"), "prn_pax").when(per_room, "prn_ac").otherwise("ppn"),
    )


def band_keys(columns: DataFrame) -> DataFrame:
    """AG6 on one row per contract: the primary and secondary key of each band."""
    assigned = band_assignment(columns)
    return assigned.groupBy("contract_id").agg(*[
        F.max(F.when(F.col("band") == band, F.col(slot))).alias(f"{band}_{slot}")
        for band in BANDS for slot in ("primary", "secondary")
    ])


def position_keys(columns: DataFrame) -> DataFrame:
    """W7 on one row per contract: key and ages of each child slot."""
    assigned = position_assignment(columns.where(blank("key").isNotNull()), ["contract_id"])
    return assigned.groupBy("contract_id").agg(*[
        F.max(F.when(F.col("slot") == n, F.col(field))).alias(f"slot_{n}_{field}")
        for n in (1, 2, 3) for field in ("key", "age_from", "age_to")
    ])


def _child(key: str) -> Column:
    return F.try_element_at("child_values", F.col(key)).cast(MONEY)


def adult_child_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """EX4: the eleven rate columns of the adult/child layout."""
    return rows.join(band_keys(columns), "contract_id", "left").withColumns(_adult_child())


def _adult_child() -> dict[str, Column]:
    return {
        "adult_1": F.col("sgl"), "adult_2": F.col("dbl"), "adult_3": F.col("tpl"), "adult_4": F.col("qdp"),
        "baby_1": _child("baby_primary"), "child_1": _child("child_primary"), "teen_1": _child("teen_primary"),
        "extra_adult": F.col("extra_bed"), "multi_infant": _child("baby_secondary"),
        "extra_child": _child("child_secondary"), "extra_teen": _child("teen_secondary"),
    }


def pax_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """EX5: the nine rate columns of the pax layout; children take the bands' primary keys."""
    return rows.join(band_keys(columns), "contract_id", "left").withColumns(_pax())


def _pax() -> dict[str, Column]:
    return {
        "pax_1": F.col("sgl"), "pax_2": F.col("dbl"), "pax_3": F.col("tpl"), "pax_4": F.col("qdp"),
        "pax_5": F.lit(None).cast(MONEY), "extra_adult": F.col("extra_bed"), "multi_infant": _child("baby_primary"),
        "extra_child": _child("child_primary"), "extra_teen": _child("teen_primary"),
    }


def child_position_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """EX6: price and ages of the three child slots."""
    return rows.join(position_keys(columns), "contract_id", "left").withColumns(_positions())


def _positions() -> dict[str, Column]:
    made = {}
    for n in (1, 2, 3):
        made[f"child_{n}_price"] = _child(f"slot_{n}_key")
        made[f"child_{n}_age_min"] = F.col(f"slot_{n}_age_from")
        made[f"child_{n}_age_max"] = F.col(f"slot_{n}_age_to")
    return made


def export_rows(rows: DataFrame, columns: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """EX7: gen-1 rows as export rows: base columns, defaults, both layouts' rate columns and the child slots.

    Columns of the layout a contract does not use are null. ``layouts`` defaults to each contract's dominant one. The
    per-contract facts are one short row per contract, joined once.
    """
    layouts = dominant_layout(rows) if layouts is None else layouts
    facts = layouts.select("contract_id", "layout").join(band_keys(columns), "contract_id", "left").join(
        position_keys(columns), "contract_id", "left"
    )
    joined = rows.join(facts, "contract_id", "left")
    have = set(rows.columns)

    def source(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    pax = F.col("layout") == "prn_pax"
    shared = ("extra_adult", "multi_infant", "extra_child", "extra_teen")
    adult, by_pax = _adult_child(), _pax()
    rates = {n: F.when(~pax, c) for n, c in adult.items() if n not in shared}
    rates |= {n: F.when(pax, c) for n, c in by_pax.items() if n not in shared}
    rates |= {n: F.when(pax, by_pax[n]).otherwise(adult[n]) for n in shared}
    currency = first_filled(source("currency"), F.lit("EUR"))
    base = {n: F.when(F.btrim(source(c)) != "", source(c)) for n, c in TEXT_COLUMNS.items()}
    base |= {n: source(n).cast("double" if n in GEO_FIELDS else "decimal(12,2)") for n in NUMBER_COLUMNS}
    base |= {n: first_filled(source(n).cast("string"), F.lit(d)) for n, d in EXPORT_DEFAULTS.items()}
    base |= {
        "currency": currency, "customer_currency": F.coalesce(blank(source("customer_currency")), currency),
        "rate_type": rate_type_of_layout("layout"), "days": days_mask(source("days")),
        "start_date": real_date(F.substring(source("start_date"), 1, 10)),
        "end_date": real_date(F.substring(source("end_date"), 1, 10)),
    }
    made = {**base, **rates, **_positions()}
    return joined.select("contract_id", "row_id", "layout", *[c.alias(n) for n, c in made.items()])
