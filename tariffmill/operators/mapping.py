"""From the canonical contract tables to hotel rate rows and supplement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, compact_number, fold, is_blank
from tariffmill.functions.dates import ALL_WEEK, format_day_first
from tariffmill.functions.names import has_ai_mark, hotel_code, without_ai_mark
from tariffmill.functions.numbers import format_cost
from tariffmill.functions.pricing import (
    adult_rate, band_price, classify_band, extra_adult, position_label, position_ordinal,
)
from tariffmill.functions.vocabulary import (
    fare_type_name, is_room_view_name, layout_of_rate_type, rate_type_of_layout, standard_count_index, supplement_type,
)
from tariffmill.operators.grid import CELL, HOTEL, rate_grid
from tariffmill.operators.shaping import group_product, group_rank, keep_top
from tariffmill.schemas import AGE, SUPPLEMENT_HEADERS, SUPPLEMENT_TYPES

# Hotel fields that may carry the mark of machine-supplied data, with their printed headers.
MARKED_FIELDS = {
    "address_line_1": "Address Line 1",
    "address_line_2": "Address Line 2",
    "address_line_3": "Address Line 3",
    "address_line_4": "Address Line 4",
    "postal_code": "Postal Code",
    "county_state_province": "County / State / Province",
    "city_area": "City / Area",
    "phone": "Phone Number",
    "email": "Email Address",
    "website": "Hotel Website",
}


def split_ai_marks(hotels: DataFrame) -> DataFrame:
    """PF10: strip the mark from ten fields and list the headers it was on; coordinates count as marked when present."""
    marks = [F.when(has_ai_mark(f), F.lit(header)) for f, header in MARKED_FIELDS.items()]
    marks += [F.when(F.col(f).isNotNull(), F.lit(f.title())) for f in ("latitude", "longitude")]
    listed = hotels.withColumn("ai_fields", F.array_compact(F.array(*marks)))
    return listed.withColumns({f: without_ai_mark(f) for f in MARKED_FIELDS})


def hotel_base_columns(hotels: DataFrame, contracts: DataFrame) -> DataFrame:
    """EX8: the hotel-level columns every rate row of a hotel repeats, with their constants."""
    layout = layout_of_rate_type("detected_rate_type")
    with_layout = split_ai_marks(hotels).join(contracts.select("contract_id", layout.alias("layout")), "contract_id")
    currency = F.coalesce(blank("currency"), F.lit("EUR"))
    return with_layout.select(
        *HOTEL, "layout", hotel_code("hotel", "code").alias("hotel_code"), "sell_channel", "supplier", "star_rating",
        "short_description", "address_line_1", "address_line_2", "address_line_3", "address_line_4", "postal_code",
        "country_code", F.col("county_state_province").alias("state_region"), "city_area", "phone", "email", "website",
        "latitude", "longitude",
        F.coalesce(blank("check_in"), F.lit("00:00")).alias("check_in"),
        F.coalesce(blank("check_out"), F.lit("00:00")).alias("check_out"),
        currency.alias("currency"), currency.alias("customer_currency"),
        rate_type_of_layout("layout").alias("rate_type"), F.lit("Open").alias("status"), F.lit(ALL_WEEK).alias("days"),
        F.lit("Contract").alias("rate_plan"), F.lit("Fixed").alias("add_charge_type"), F.lit("Mark Up").alias("charge"),
        "ai_fields",
    )


def rate_columns(rates: DataFrame) -> DataFrame:
    """EX9 and EX10: the price columns of the row's layout; the other layout's stay null."""
    pax = F.col("layout") == "prn_pax"
    amount = extra_adult("extra_bed_adult", "extra_bed_adult_kind", "dbl", "sgl")
    by_guests = {"1": "sgl", "2": "dbl", "3": "tpl", "4": "qdp"}
    return rates.withColumns({
        **{f"adult_{n}": F.when(~pax, F.col(c)) for n, c in by_guests.items()},
        **{f"pax_{n}": F.when(pax, F.col(c)) for n, c in by_guests.items()},
        "pax_5": F.lit(None).cast("decimal(12,2)"),
        "extra_adult": amount,
    })


def map_hotel_rows(
    hotels: DataFrame, rooms: DataFrame, seasons: DataFrame, meals: DataFrame, rates: DataFrame, contracts: DataFrame,
) -> DataFrame:
    """The hotel rate sheet: every grid cell with its prices and its hotel's columns."""
    boards = keep_top(meals, [*HOTEL, "code"], [F.desc("ord")]).select(
        *HOTEL, F.col("code").alias("meal"), F.col("canonical").alias("_board")
    )
    grid = rate_grid(rooms, seasons, meals, rates, attributes=True).join(boards, [*HOTEL, "meal"], "left")
    rows = grid.join(hotel_base_columns(hotels, contracts), HOTEL)
    return rate_columns(rows).withColumn("meal_plan", F.coalesce(blank("_board"), "canonical")).drop(
        "_board", "canonical", "sgl", "dbl", "tpl", "qdp"
    )


def in_supplement_scope(supplements: DataFrame) -> DataFrame:
    """PF8: room views are priced in the hotel sheet and leave the supplement sheet."""
    view = (F.col("kind") == "room_view") | ((F.col("kind") == "other") & is_room_view_name("name"))
    return supplements.where(~F.coalesce(view, F.lit(False)))


def hotel_lookup(hotels: DataFrame) -> DataFrame:
    """J4's right side: code, supplier, currency and mark per hotel name; the last hotel of a name wins."""
    return keep_top(hotels, HOTEL, [F.desc("ord")]).select(
        *HOTEL, hotel_code("hotel", "code").alias("hotel_code"), without_ai_mark("supplier").alias("supplier"),
        "currency", has_ai_mark("supplier").alias("supplier_is_ai"),
    )


def join_hotel(supplements: DataFrame, hotels: DataFrame) -> DataFrame:
    """Supplements with their hotel's code, supplier and currency (EUR when unknown)."""
    return supplements.join(hotel_lookup(hotels), HOTEL, "left").withColumns({
        "currency": F.coalesce(blank("currency"), F.lit("EUR")),
        "supplier_is_ai": F.coalesce("supplier_is_ai", F.lit(False)),
    })


def room_limits(rooms: DataFrame) -> DataFrame:
    """J5's right side: occupancy limits per room name; the last room of a name wins."""
    return keep_top(rooms.where(~is_blank("room")), [*HOTEL, "room"], [F.desc("ord")]).select(
        *HOTEL, F.col("room").alias("rooms"), "min_adult", "max_adult", F.col("max_children").alias("max_child")
    )


def join_room(supplements: DataFrame, rooms: DataFrame) -> DataFrame:
    """Supplements scoped to one named room take its occupancy limits."""
    return supplements.join(room_limits(rooms), [*HOTEL, "rooms"], "left")


def _supplement_row(df: DataFrame, values: dict[str, Column | str]) -> DataFrame:
    """The 34 supplement columns; columns without a value are null, forced ones filled."""
    forced = {
        "display_on_customer_documentation": F.lit("Yes"),
        "display_on_supplier_notification": F.lit("Yes"),
        **values,
    }
    columns = [
        (F.col(forced[name]) if isinstance(forced[name], str) else forced[name])
        .cast(SUPPLEMENT_TYPES.get(name, "string")).alias(name)
        if name in forced else F.lit(None).cast(SUPPLEMENT_TYPES.get(name, "string")).alias(name)
        for name in SUPPLEMENT_HEADERS
    ]
    marked = F.coalesce(F.col("supplier_is_ai"), F.lit(False)) & ~F.coalesce(is_blank("supplier"), F.lit(True))
    ai_fields = F.when(marked, F.array(F.lit("Supplier"))).otherwise(F.array().cast("array<string>"))
    return df.select("contract_id", *columns, ai_fields.alias("ai_fields"))


def build_supplement_rows(supplements: DataFrame, hotels: DataFrame, rooms: DataFrame) -> DataFrame:
    """EX11: contract supplements as supplement sheet rows."""
    joined = join_room(join_hotel(in_supplement_scope(supplements), hotels), rooms)
    return _supplement_row(joined, {
        "hotel": "hotel", "hotel_code": "hotel_code", "supplement_code": "code", "supplement_name": "name",
        "rooms": F.coalesce(blank("rooms"), F.lit("ALL")), "rate_plans": "rate_plans", "min_stay": "min_stay",
        "max_stay": "max_stay", "supplement_type": supplement_type("kind", "name", "description"),
        "display_as_separate_room": F.coalesce(blank("display_as_separate_room"), F.lit("No")),
        "description": "description", "contract_period": "contract_period", "season_name": "season_label",
        "start_date": format_day_first("start_date"), "end_date": format_day_first("end_date"),
        "supplier": "supplier", "currency": "currency", "charge_type": "charge_type",
        "calculation_method": "calculation_method", "traveler_type": "traveler_type",
        "fare_type_name": fare_type_name("calculation_method", "traveler_type", "fare_type_name"),
        "standard_count_index": standard_count_index("calculation_method", "charge_type", "ordinal"),
        "min_age": "age_min", "max_age": "age_max", "min_adult": "min_adult", "max_adult": "max_adult",
        "max_child": "max_child", "supplier_cost": format_cost("supplier_cost", "cost_format"),
        "customer_price": format_cost(F.coalesce("customer_price", "supplier_cost"), "cost_format"),
    })


def room_base_rate(rooms: DataFrame, rates: DataFrame) -> DataFrame:
    """AG4: each room's cheapest double rate, the hotel's as fallback.

    A room at no more than 30 and half the hotel's dearest rate is a mislabelled view supplement and takes that rate.
    """
    priced = rates.where(F.col("dbl").isNotNull())
    per_room = priced.groupBy(*HOTEL, "room").agg(F.min("dbl").alias("_own"))
    per_hotel = priced.groupBy(*HOTEL).agg(F.min("dbl").alias("fallback"), F.max("dbl").alias("_top"))
    view_like = (F.col("_top") != 0) & (F.col("_own") <= 30) & (F.col("_own") * 2 <= F.col("_top"))
    return (
        rooms.select(*HOTEL, "room").distinct()
        .join(per_room, [*HOTEL, "room"], "left").join(per_hotel, HOTEL, "left")
        .select(*HOTEL, "room", F.when(view_like, F.col("_top")).otherwise(F.col("_own")).alias("base_rate"), "fallback")
    )


def bands_per_room(bands: DataFrame, rooms: DataFrame) -> DataFrame:
    """Each band with the rooms it applies to.

    Names are matched case-insensitively by an equi join. A band that names no room, or none the hotel has, goes to
    every room, and to 'ALL' when the hotel lists no rooms.
    """
    named = rooms.where(~is_blank("room")).select(*HOTEL, "room", F.col("ord").alias("room_ord"))
    scoped = bands.withColumn(
        "_name", F.explode(F.array_distinct(F.transform("applies_to_rooms", lambda r: fold(r))))
    ).join(named.withColumn("_name", fold("room")), [*HOTEL, "_name"]).drop("_name")
    everywhere = bands.join(scoped.select(*HOTEL, "ord").distinct(), [*HOTEL, "ord"], "left_anti")
    spread = group_product(everywhere, named, HOTEL, ["ord"])
    roomless = bands.join(named.select(*HOTEL).distinct(), HOTEL, "left_anti").withColumns(
        {"room": F.lit("ALL"), "room_ord": F.lit(0)}
    )
    return scoped.unionByName(spread).unionByName(roomless)


def child_policy_supplements(
    hotels: DataFrame, rooms: DataFrame, rates: DataFrame, bands: DataFrame,
) -> DataFrame:
    """EX12: one supplement row per band and room it applies to, priced from the room's base rate."""
    offered = bands.where(F.col("value_type") != "not_applicable")
    numbered = group_rank(offered, HOTEL, "ord", "_place")
    rate = F.coalesce(F.nullif("base_rate", F.lit(0)), "fallback")
    rows = (
        bands_per_room(numbered, rooms)
        .join(room_base_rate(rooms, rates), [*HOTEL, "room"], "left")
        .join(rates.where(F.col("dbl").isNotNull()).groupBy(*HOTEL).agg(F.min("dbl").alias("_cheapest")), HOTEL, "left")
        .withColumn("fallback", F.coalesce("fallback", "_cheapest"))
        .withColumn("_cost", band_price("value_type", "value", rate))
        .join(hotel_lookup(hotels), HOTEL)
        .withColumnRenamed("room", "rooms")
        .join(room_limits(rooms), [*HOTEL, "rooms"], "left")
    )
    index = F.coalesce(position_ordinal("position"), F.col("_place")).cast("int")
    label = position_label("position")
    low, high = compact_number(F.col("age_from").cast(AGE)), compact_number(F.col("age_to").cast(AGE))
    ages = F.concat(low, F.lit("-"), high)
    worth = F.coalesce(F.concat(F.lit("="), compact_number("value")), F.lit(""))
    return _supplement_row(rows, {
        "hotel": "hotel", "hotel_code": "hotel_code",
        "supplement_code": F.concat(F.lit("CHILD-"), index.cast("string"), F.lit("-"), ages),
        "supplement_name": F.lit("Child policy"), "rooms": "rooms", "supplement_type": F.lit("Compulsory"),
        "display_as_separate_room": F.lit("No"),
        "description": F.concat(label, F.lit(" age band "), ages, F.lit("; "), "value_type", worth),
        "supplier": "supplier", "currency": F.coalesce(blank("currency"), F.lit("EUR")),
        "charge_type": F.lit("Per Person Per Night"), "calculation_method": F.lit("Pax Index"),
        "traveler_type": F.when(F.col("age_to") <= 2, "Infant").otherwise("Child"),
        "fare_type_name": F.coalesce(blank("label"), F.concat(label, F.lit(" ("), ages, F.lit(")"))),
        "standard_count_index": index, "min_age": "age_from", "max_age": "age_to", "min_adult": "min_adult",
        "max_adult": "max_adult", "max_child": "max_child", "supplier_cost": "_cost", "customer_price": "_cost",
    })


def meal_upgrade_deltas(rates: DataFrame) -> DataFrame:
    """Per (room, season) the cheapest meal is the base; dearer meals with their difference to it.

    A repeated meal keeps its last price and its first place in line. The window runs over the distinct meals of one
    room and season.
    """
    cells = rates.groupBy(*CELL).agg(
        F.max_by(adult_rate("dbl", "sgl"), F.col("ord")).alias("amount"), F.min("ord").alias("ord")
    )
    w = Window.partitionBy(*HOTEL, "room", "season")
    cheapest = w.orderBy(F.asc_nulls_last("amount"), F.asc("ord"))
    return (
        cells.withColumns({
            "base_meal": F.first("meal").over(cheapest), "base_amount": F.first("amount").over(cheapest),
            "_meals": F.count(F.lit(1)).over(w),
        })
        .where((F.col("_meals") >= 2) & (F.col("amount") > F.col("base_amount")))
        .select(*CELL, "base_meal", (F.col("amount") - F.col("base_amount")).cast("decimal(12,2)").alias("delta"))
    )


def meal_upgrade_rows(
    rates: DataFrame, hotels: DataFrame, rooms: DataFrame, seasons: DataFrame, meals: DataFrame,
) -> DataFrame:
    """EX13: one Adult supplement row per dearer meal of hotels that list at least two meals."""
    several = meals.groupBy(*HOTEL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).drop("_n")
    boards = keep_top(meals, [*HOTEL, "code"], [F.desc("ord")]).select(*HOTEL, "code", "canonical")
    season = keep_top(seasons, [*HOTEL, "label"], [F.desc("ord")]).select(
        *HOTEL, F.col("label").alias("season"), "min_stay", "start_date", "end_date"
    )
    base_boards = boards.select(*HOTEL, F.col("code").alias("base_meal"), F.col("canonical").alias("_base"))
    rows = (
        meal_upgrade_deltas(rates).join(several, HOTEL, "left_semi")
        .join(boards.withColumnRenamed("code", "meal"), [*HOTEL, "meal"], "left")
        .join(base_boards, [*HOTEL, "base_meal"], "left")
        .join(season, [*HOTEL, "season"], "left")
        .join(hotel_lookup(hotels), HOTEL)
        .withColumnRenamed("room", "rooms")
        .join(room_limits(rooms), [*HOTEL, "rooms"], "left")
        .withColumn("_name", F.coalesce(blank("canonical"), "meal"))
    )
    return _supplement_row(rows, {
        "hotel": "hotel", "hotel_code": "hotel_code", "supplement_code": F.concat(F.lit("SUP-"), "meal"),
        "supplement_name": F.concat("_name", F.lit(" upgrade")), "rooms": "rooms", "min_stay": "min_stay",
        "supplement_type": F.lit("Exclusive"), "display_as_separate_room": F.lit("No"),
        "description": F.concat("_name", F.lit(" supplement over "), F.coalesce("_base", "base_meal")),
        "season_name": "season", "start_date": format_day_first("start_date"), "end_date": format_day_first("end_date"),
        "supplier": "supplier", "currency": F.coalesce(blank("currency"), F.lit("EUR")),
        "charge_type": F.lit("Per Person Per Night"), "calculation_method": F.lit("Standard"),
        "traveler_type": F.lit("Adult"), "fare_type_name": F.lit("Per Adult"), "min_adult": "min_adult",
        "max_adult": "max_adult", "max_child": "max_child", "supplier_cost": "delta", "customer_price": "delta",
    })


def child_band_columns(rates: DataFrame, bands: DataFrame) -> DataFrame:
    """EX14: each rate with the prices of its hotel's first and second baby, child and teen band."""
    ranked = keep_top(
        bands.withColumn("band", classify_band("age_from", "age_to")), [*HOTEL, "band"], [F.asc("ord")], 2,
        rank_as="_place",
    )
    slots = {
        "baby_1": ("baby", 1), "child_1": ("child", 1), "teen_1": ("teen", 1),
        "multi_infant": ("baby", 2), "extra_child": ("child", 2), "extra_teen": ("teen", 2),
    }
    per_hotel = ranked.groupBy(*HOTEL).agg(*[
        F.max(F.when((F.col("band") == band) & (F.col("_place") == place), F.struct("value_type", "value"))).alias(f"_{n}")
        for n, (band, place) in slots.items()
    ])
    adult = adult_rate("dbl", "sgl")
    return rates.join(per_hotel, HOTEL, "left").withColumns({
        n: band_price(F.col(f"_{n}.value_type"), F.col(f"_{n}.value"), adult) for n in slots
    }).drop(*[f"_{n}" for n in slots])


def supplement_union(*parts: DataFrame) -> DataFrame:
    """SO6: the supplement sheet from its three sources."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
