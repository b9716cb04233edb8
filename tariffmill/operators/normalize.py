"""Gen-1 rows: defaults, vocabulary, dates, numbers, child prices, and notes for what could not be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, first_filled, is_blank, squeezed
from tariffmill.functions.dates import iso_date_of, mask_of, repair_end_date
from tariffmill.functions.numbers import free_value, read_number, unread_text
from tariffmill.functions.pricing import child_amount, extra_bed_amount, money
from tariffmill.functions.vocabulary import board_of, currency_of, rate_type_of, status_of, upper_text
from tariffmill.operators.child_columns import normalize_columns
from tariffmill.operators.shaping import last_row
from tariffmill.schemas import (
    CELL_META, GEO_FIELDS, HOTEL_HEADERS, INTEGER_FIELDS, MONEY, NUMBER, NUMERIC_FIELDS, PRICE_FIELDS, SUPP_HEADERS,
)

HEADERS = {**HOTEL_HEADERS, **SUPP_HEADERS}
NO_PAGE = "—"

# Row fields filled from the contract's options when blank.
DEFAULTED = {
    "supplier": "supplier",
    "country_code": "country",
    "city_area": "city_area",
    "currency": "currency",
    "customer_currency": "currency",
    "check_in": "check_in",
    "check_out": "check_out",
    "status": "status",
}


def _with_options(rows: DataFrame, options: DataFrame) -> DataFrame:
    renamed = last_row(options, ["contract_id"]).select("contract_id", *[F.col(c).alias(f"_opt_{c}") for c in set(DEFAULTED.values())])
    return rows.join(renamed, "contract_id", "left")


def apply_defaults(rows: DataFrame, options: DataFrame) -> DataFrame:
    """PF1: blank fields take the contract's defaults; of several option rows the last one's."""
    filled = {f: F.coalesce(blank(f), blank(f"_opt_{o}"), F.col(f)) for f, o in DEFAULTED.items()}
    return _with_options(rows, options).withColumns(filled).drop(*[f"_opt_{o}" for o in set(DEFAULTED.values())])


def apply_meta(rows: DataFrame, meta: DataFrame, options: DataFrame) -> DataFrame:
    """Hotel fields from the sheet's own heading, else from the options. ``meta`` holds one row per document."""
    own = meta.select(
        "contract_id", "doc_id", F.col("name").alias("_name"), F.col("supplier").alias("_supplier"),
        F.col("country_code").alias("_country"), F.col("state_or_region").alias("_state"),
        F.col("city_or_area").alias("_city"), F.col("currency").alias("_currency"),
        F.col("rate_type").alias("_rate_type"), F.col("stars").alias("_stars"),
    )
    joined = _with_options(rows.join(own, ["contract_id", "doc_id"], "left"), options)
    currency = F.coalesce(blank("_currency"), F.col("_opt_currency"))
    return joined.withColumns({
        "hotel": F.coalesce(blank("_name"), "hotel"),
        "supplier": F.coalesce(blank("_supplier"), F.col("_opt_supplier")),
        "country_code": F.coalesce(blank("_country"), F.col("_opt_country")),
        "state_region": F.col("_state"),
        "city_area": F.coalesce(blank("_city"), F.col("_opt_city_area")),
        "currency": currency,
        "customer_currency": currency,
        "rate_type": F.col("_rate_type"),
        "star_rating": F.coalesce(blank("_stars"), "star_rating"),
    }).drop(
        "_name", "_supplier", "_country", "_state", "_city", "_currency", "_rate_type", "_stars",
        *[f"_opt_{o}" for o in set(DEFAULTED.values())],
    )


def normalize_vocabulary(rows: DataFrame) -> DataFrame:
    """Currencies, board, rate type and status by their vocabularies; unknown text stays.

    The upper-case texts are columns of their own, so the many tests on them share one conversion per row.
    """
    rules = {
        "currency": currency_of, "customer_currency": currency_of, "meal_plan": board_of, "rate_type": rate_type_of,
        "status": status_of,
    }
    upper = rows.withColumns({f"_u_{f}": upper_text(f) for f in rules})
    return upper.withColumns({
        f: F.coalesce(rule(F.col(f"_u_{f}")), F.col(f)) for f, rule in rules.items()
    }).drop(*[f"_u_{f}" for f in rules])


def repair_end_year(rows: DataFrame) -> DataFrame:
    """An end date typed into an earlier year moves to the start's year, with a warning."""
    moved = repair_end_date("start_date", "end_date")
    warning = F.concat(
        F.lit("End Date year auto-corrected from "), "end_date", F.lit(" -> "), moved,
        F.lit(" (source contract typo)"),
    )
    return rows.withColumns({
        "warnings": F.when(moved.isNotNull(), F.array_append(_warnings(), warning)).otherwise(_warnings()),
        "end_date": F.coalesce(moved, "end_date"),
    })


def _warnings() -> Column:
    return F.coalesce("warnings", F.array().cast("array<string>"))


def _moved(field: Column, prose: Column) -> Column:
    return F.when(prose.isNotNull(), F.struct(field.alias("field"), prose.alias("prose")))


def prose_to_notes(rows: DataFrame) -> DataFrame:
    """The numeric fields as numbers; what was text is nulled and listed in ``moved_fields``.

    Nothing is unpivoted until notes are asked for. Text, number and leftover text are columns of their own, each used
    more than once, so Catalyst keeps the steps apart and every field is read once per row.
    """
    stripped = rows.withColumns({f"_s_{f}": squeezed(f) for f in NUMERIC_FIELDS})
    kinds = {f: "int" if f in INTEGER_FIELDS else NUMBER if f in GEO_FIELDS else MONEY for f in NUMERIC_FIELDS}
    # A number that the field cannot hold is text like any other.
    numbered = stripped.withColumns({
        f"_n_{f}": read_number(F.col(f"_s_{f}"), f in INTEGER_FIELDS).try_cast(kinds[f]) for f in NUMERIC_FIELDS
    })
    parted = numbered.withColumns({
        f"_p_{f}": unread_text(F.col(f"_s_{f}"), F.col(f"_n_{f}")) for f in NUMERIC_FIELDS
    })
    moved = F.array_compact(F.array(*[_moved(F.lit(HEADERS[f]), F.col(f"_p_{f}")) for f in NUMERIC_FIELDS]))
    typed = {f: F.col(f"_n_{f}") for f in NUMERIC_FIELDS}
    told = F.transform("moved_fields", lambda m: F.concat(
        m["field"], F.lit(": '"), m["prose"], F.lit("' moved to Extraction Notes")
    ))
    return (
        parted.withColumns({"moved_fields": moved, **typed}).withColumn("warnings", F.concat(_warnings(), told))
        .drop(*[f"_{p}_{f}" for p in "snp" for f in NUMERIC_FIELDS])
    )


def child_prose_to_notes(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Child values as numbers, by their column's unit, with exactly the contract's keys.

    Text is nulled and listed in ``moved_children``. Keys come as one short array per contract; values stay in their
    row's map throughout.
    """
    keys = columns.groupBy("contract_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "key", "value_type"))).alias("_columns")
    )
    joined = rows.join(keys, "contract_id", "left").withColumn(
        "_columns", F.coalesce("_columns", F.array().cast("array<struct<ord:int,key:string,value_type:string>>"))
    )
    texts = F.transform("_columns", lambda c: F.struct(
        c["key"].alias("key"), free_value(c["value_type"]).alias("free"),
        squeezed(F.try_element_at("child_values", c["key"])).alias("text"),
    ))
    read = F.transform(texts, lambda c: F.struct(
        c["key"].alias("key"), c["text"].alias("text"), read_number(c["text"], free=c["free"]).try_cast(MONEY).alias("num")
    ))
    moved = F.transform(
        F.filter("_read", lambda r: unread_text(r["text"], r["num"]).isNotNull()),
        lambda r: F.struct(r["key"].alias("field"), r["text"].alias("prose")),
    )
    told = F.transform("moved_children", lambda m: F.concat(
        m["field"], F.lit(": '"), m["prose"], F.lit("' moved to Extraction Notes")
    ))
    clean = F.map_from_entries(F.transform("_read", lambda r: F.struct(r["key"], r["num"])))
    return (
        joined.withColumn("_read", read).withColumns({"moved_children": moved, "child_values": clean})
        .withColumn("warnings", F.concat(_warnings(), told)).drop("_read", "_columns")
    )


def moved_text_notes(rows: DataFrame) -> DataFrame:
    """The notes of N3 and N4, one per moved text."""
    def entries(column: str, category: str, text) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast("array<struct<field:string,prose:string>>")),
            lambda m: F.struct(F.lit(category).alias("category"), text(m).alias("note")),
        )

    fields = entries("moved_fields", "Rate anomaly", lambda m: F.concat(
        F.lit("Field '"), m["field"], F.lit("' on row "), F.col("row_id"),
        F.lit(" contained non-numeric text and was moved here for review: '"), m["prose"], F.lit("'"),
    ))
    children = entries("moved_children", "Child policy", lambda m: F.concat(
        F.lit("Child column '"), m["field"], F.lit("' on row "), F.col("row_id"),
        F.lit(" contained non-numeric text and was moved here for review: '"), m["prose"], F.lit("'"),
    ))
    told = rows.where((F.size("moved_fields") > 0) | (F.size("moved_children") > 0)).select(
        "contract_id", F.col("row_id").alias("linked_row_id"), "hotel",
        F.coalesce("sheet", F.lit(NO_PAGE)).alias("page"), "source_refs", F.explode(F.concat(fields, children)).alias("n"),
    )
    return told.select(
        "contract_id", "page", "n.category", "n.note", "source_refs", F.lit(0.4).alias("confidence"), "hotel",
        "linked_row_id",
    )


def detect_percentage_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """AG5: a column that is not declared a percentage but holds only values in [0, 1] is a share of the adult rate."""
    return _shares_typed(columns, rows.select("contract_id", F.explode("child_values").alias("key", "_v")))


def detect_percentage_texts(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """AG5 on child values that are text yet: a contract's distinct texts are read once each, not once a row."""
    texts = rows.select("contract_id", F.explode("child_values").alias("key", "_text")).distinct()
    read = texts.join(columns.select("contract_id", "key", "value_type"), ["contract_id", "key"])
    value = _child_number(squeezed("_text"), F.col("value_type"))
    return _shares_typed(columns, read.select("contract_id", "key", value.alias("_v")))


def _child_number(text: Column, value_type: Column) -> Column:
    return read_number(text, free=free_value(value_type)).try_cast(MONEY)


def _shares_typed(columns: DataFrame, values: DataFrame) -> DataFrame:
    seen = values.where(F.col("_v").isNotNull()).groupBy("contract_id", "key").agg(
        F.bool_and(F.col("_v").between(0, 1)).alias("_share")
    )
    open_type = F.coalesce(F.col("value_type").isin("amount", "unknown"), F.lit(True))
    return columns.join(seen, ["contract_id", "key"], "left").withColumn(
        "value_type",
        F.when(open_type & F.coalesce("_share", F.lit(False)), "percentage_of_adult").otherwise(F.col("value_type")),
    ).drop("_share")


def discount_to_amount(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Percentage child values and flagged extra beds as money of the row's double rate."""
    percent = columns.where(F.col("value_type").isin("discount_percentage", "percentage_of_adult"))
    types = percent.groupBy("contract_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value_type"))).alias("_types")
    )
    converted = F.transform_values("child_values", lambda k, v: child_amount(F.try_element_at("_types", k), v, "dbl"))
    values = F.when(F.col("_types").isNotNull() & F.col("dbl").isNotNull(), converted).otherwise(F.col("child_values"))
    flag = F.col("extra_bed_is_pct") if "extra_bed_is_pct" in rows.columns else F.lit(False)
    return rows.join(types, "contract_id", "left").withColumns({
        "child_values": values, "extra_bed": extra_bed_amount("extra_bed", flag, "dbl"),
    }).drop("_types", "extra_bed_is_pct")


def columns_as_amounts(columns: DataFrame) -> DataFrame:
    """After conversion a percentage column holds money: type and label say so."""
    percent = F.col("value_type").isin("discount_percentage", "percentage_of_adult")
    return columns.withColumns({
        "label": F.when(percent, F.coalesce(blank("key"), "label")).otherwise(F.col("label")),
        "value_type": F.when(percent, "amount").otherwise(F.col("value_type")),
    })


def normalize_rows(
    rows: DataFrame, columns: DataFrame, options: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, child columns and new notes. ``rows`` hold raw text in every field; ``child_values`` maps to text.

    The read rows feed all three results. ``keep`` may store them in between (``session.stage``), which also keeps later
    filters from being pushed into, and repeated over, the long reading expressions.
    """
    sorted_columns = normalize_columns(columns)
    stripped = normalize_vocabulary(apply_defaults(rows, options)).withColumns({
        c: squeezed(c) for c in ("start_date", "end_date", "days")
    })
    dated = stripped.withColumns({
        "start_date": iso_date_of(F.col("start_date")), "end_date": iso_date_of(F.col("end_date")), "days": mask_of(F.col("days")),
    })
    read = child_prose_to_notes(prose_to_notes(repair_end_year(dated)), sorted_columns)
    filled = read.withColumns({
        "sheet": F.coalesce("sheet", F.lit(NO_PAGE)),
        "source_refs": F.coalesce("source_refs", F.array().cast("array<string>")),
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "cell_meta": F.coalesce("cell_meta", F.create_map().cast(CELL_META)),
        "review_state": F.coalesce("review_state", F.lit("auto")),
    })
    filled = keep(filled)
    typed = detect_percentage_texts(rows, sorted_columns)
    done = discount_to_amount(filled, typed)
    return done.drop("moved_fields", "moved_children"), columns_as_amounts(typed), moved_text_notes(filled)


def page_rows(rows: DataFrame) -> DataFrame:
    """Rows read off a page get its reference and the page reader's defaults."""
    return rows.withColumns({
        "row_id": F.coalesce("row_id", row_key()),
        "sheet": F.col("page_id"),
        "source_refs": F.coalesce("source_refs", F.array("source_ref")),
        "confidence": F.coalesce("confidence", F.lit(0.7)),
        "warnings": _warnings(),
        "cell_meta": F.coalesce("cell_meta", F.create_map().cast(CELL_META)),
        "review_state": F.coalesce("review_state", F.lit("auto")),
    })


def row_key() -> Column:
    """A stable row id from where the row was read: no random ids, so a re-run gives the same table."""
    return F.concat(F.lit("row_"), F.substring(F.sha2(F.concat_ws("|", "contract_id", "page_id", "ord"), 256), 1, 16))


def page_notes(notes: DataFrame) -> DataFrame:
    """Notes read off a page; blank categories become Other, missing confidence one half."""
    no_refs = F.col("source_refs").isNull() | (F.size("source_refs") == 0)
    confidence = F.nullif(F.col("confidence"), F.lit(0.0))
    return notes.withColumns({
        "page": F.col("page_id"),
        "category": first_filled("category", F.lit("Other")),
        "note": F.coalesce("note", F.lit("")),
        "source_refs": F.when(no_refs, F.array("source_ref")).otherwise(F.col("source_refs")),
        "confidence": F.coalesce(confidence, F.lit(0.5)),
        "linked_row_id": F.lit(None).cast("string"),
    })


def has_price(fields: tuple[str, ...] = PRICE_FIELDS) -> Column:
    """PF3: any occupancy price or any child value present."""
    any_field = F.coalesce(*[blank(F.col(f).cast("string")) for f in fields]).isNotNull()
    any_child = F.exists(F.map_values("child_values"), lambda v: v.isNotNull())
    return any_field | F.coalesce(any_child, F.lit(False))


def drop_skeleton_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF2: rows with neither hotel nor price leave the table; each contract gets one note that counts them."""
    keep = (F.coalesce(F.btrim("hotel"), F.lit("")) != "") | has_price()
    pages = F.array_join(F.array_sort(F.collect_set(F.coalesce("sheet", F.lit(NO_PAGE)))), ",")
    notes = rows.where(~keep).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("_n"), pages.alias("page")
    ).select(
        "contract_id", "page", F.lit("Source ambiguity").alias("category"), F.concat(
            F.col("_n").cast("string"),
            F.lit(" candidate row(s) were dropped because they had neither a Hotel Name nor any rate values. These were "
                  "likely occupancy / min-stay artifacts. Review the source preview if you expect rates from those "
                  "rows."),
        ).alias("note"), F.lit(0.2).alias("confidence"),
    )
    return rows.where(keep), notes


def clear_child_values(rows: DataFrame, max_child: Column) -> DataFrame:
    """PF13: rooms that take no children lose their child values and say so."""
    none = F.coalesce(max_child <= 0, F.lit(False)) & ~is_blank("room")
    warning = F.concat(
        F.lit("Child rates cleared because occupancy table says Max Children = 0 for room '"), "room", F.lit("'.")
    )
    emptied = F.transform_values("child_values", lambda k, v: F.when(F.lit(False), v))
    return rows.withColumns({
        "child_values": F.when(none, emptied).otherwise(F.col("child_values")),
        "warnings": F.when(none, F.array_append(_warnings(), warning)).otherwise(_warnings()),
    })


def widen_child_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EX3: one column per key; absent keys are null, unknown ones dropped."""
    return rows.withColumns({k: F.try_element_at("child_values", F.lit(k)) for k in keys}).drop("child_values")


def row_prices() -> Column:
    """All prices of a row, child values included, as one array without nulls."""
    own = F.array(*[money(f) for f in PRICE_FIELDS])
    children = F.coalesce(F.map_values("child_values"), F.array().cast("array<decimal(12,2)>"))
    return F.array_compact(F.concat(own, children))
