"""Rows and notes from running text by pattern alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank
from tariffmill.functions.dates import date_pairs, days_inclusive
from tariffmill.functions.names import detect_child_keys, mentions_child
from tariffmill.functions.vocabulary import detect_currency, detect_meal_plan

# Note categories and the words that call for one, in order; what a word may begin with, in any case and
# with the long s that counts as one, is looked for first, so that other characters cost one test.
NOTE_TRIGGERS = {
    category: rf"(?=[{first}])(?iU)\b({words})\b" for category, (first, words) in {
        "Taxes/service": ("tTsSſvVmM", "tax(es)?|service charge|VAT|municipality"),
        "Cancellation": ("cCnNeE", "cancellation|no[- ]show|no show|early departure"),
        "Gala dinner": ("gGcCnN", "gala|christmas|new ?year"),
        "Special offer": ("sSſpPfF", "special offer|promotion|free night|stay pay"),
        "Booking window": ("bBeE", "booking window|EBD|early booking"),
        "Minimum stay": ("mM", "min(imum)? stay|MLOS"),
        "Child policy": ("cCfFiIİı", "child policy|free of charge|FOC|infant"),
    }.items()
}
WARNING = "Stub extractor produced this row from coarse pattern matching — review every field."


def period_pairs(documents: DataFrame, text: str = "raw_excerpt") -> DataFrame:
    """Every date pair of each document, numbered from 0."""
    return documents.select(
        "contract_id", "doc_id", F.posexplode(date_pairs(text)).alias("pair_ord", "_p")
    ).select("contract_id", "doc_id", "pair_ord", "_p.start_date", "_p.end_date")


def rate_periods(documents: DataFrame, text: str = "raw_excerpt", limit: int | None = None) -> DataFrame:
    """The pairs that become rate periods: all, or the first ``limit``, cut before they are unnested."""
    return documents.select(
        "contract_id", "doc_id", F.posexplode(_first(date_pairs(text), limit)).alias("pair_ord", "_p")
    ).select("contract_id", "doc_id", "pair_ord", "_p.start_date", "_p.end_date")


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def _snippet(text: Column, pattern: str) -> Column:
    start = F.regexp_instr(text, F.lit(pattern)) - 1
    length = F.length(F.regexp_substr(text, F.lit(pattern)))
    first = F.greatest(start - 40, F.lit(0))
    cut = F.substring(text, first + 1, start + length + 80 - first)
    return F.regexp_replace(F.regexp_replace(cut, r"^\s+|\s+$", ""), "\n", " ")


def trigger_notes(documents: DataFrame, text: str = "raw_excerpt") -> DataFrame:
    """Per document and category the first hit with its surroundings. One scan, all categories in one array."""
    return _told(documents, text, _hits())


def _told(documents: DataFrame, text: str, notes: list[Column]) -> DataFrame:
    """A row for each of a document's ``notes`` that is not null; these read the text as ``_body``, made once a document."""
    read = documents.select(
        "contract_id", "doc_id", "source_ref", hotel_of_document().alias("hotel"), F.coalesce(F.col(text), F.lit("")).alias("_body"),
    )
    return read.select("contract_id", "doc_id", "source_ref", "hotel", F.inline(F.array_compact(F.array(*notes))))


def _note(category: str, note: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), note.alias("note"))


def _hits() -> list[Column]:
    body = F.col("_body")
    return [F.when(body.rlike(pattern), _note(category, _snippet(body, pattern))) for category, pattern in NOTE_TRIGGERS.items()]


def hotel_of_document() -> Column:
    sheet = F.when(F.col("kind") == "excel_sheet", F.regexp_replace("doc_id", "^Sheet:", ""))
    return F.coalesce(blank("detected_hotel_name"), sheet, F.lit("Unknown Hotel"))


def text_child_columns(documents: DataFrame, text: str = "raw_excerpt") -> DataFrame:
    """FN20: the child columns a contract's texts name; CHD(Child) when children are mentioned without ages.

    Keys are made distinct per contract by a grouped minimum of their first place, never by gathering texts.
    """
    found = documents.select(
        "contract_id", F.col("ord").alias("doc_ord"), F.posexplode(detect_child_keys(text)).alias("pos", "key")
    ).groupBy("contract_id", "key").agg(F.min(F.struct("doc_ord", "pos")).alias("first_at"))
    aged = found.select(
        "contract_id", "key", F.regexp_extract("key", r"\((.*)-", 1).cast("decimal(5,2)").alias("age_from"),
        F.regexp_extract("key", r"-(.*)\)", 1).cast("decimal(5,2)").alias("age_to"), F.lit("amount").alias("value_type"),
        "first_at",
    )
    spoken = documents.groupBy("contract_id").agg(
        F.bool_or(mentions_child(text)).alias("_spoken"), F.min(F.struct(F.col("ord").alias("doc_ord"), F.lit(0).alias("pos"))).alias("first_at")
    ).where("_spoken").join(found.select("contract_id").distinct(), "contract_id", "left_anti")
    unaged = spoken.select(
        "contract_id", F.lit("CHD(Child)").alias("key"), F.lit(None).cast("decimal(5,2)").alias("age_from"),
        F.lit(None).cast("decimal(5,2)").alias("age_to"), F.lit("unknown").alias("value_type"), "first_at",
    )
    return aged.unionByName(unaged)


def text_rows(documents: DataFrame, options: DataFrame, text: str = "raw_excerpt", limit: int | None = None) -> DataFrame:
    """EX15's rows: a row a period (the first ``limit``) of each document that is no index, with currency, board, defaults."""
    chosen = options.select(
        "contract_id", F.col("supplier").alias("_supplier"), F.col("country").alias("_country"),
        F.col("city_area").alias("_city"), F.col("currency").alias("_currency"), F.col("status").alias("_status"),
        F.col("check_in").alias("_in"), F.col("check_out").alias("_out"),
    )
    read = documents.where(F.coalesce(F.col("classification") != "index_reference", F.lit(True))).select(
        "contract_id", "doc_id", "source_ref", hotel_of_document().alias("hotel"),
        detect_currency(text).alias("_found"), detect_meal_plan(text).alias("meal_plan"),
        F.posexplode(_first(date_pairs(text), limit)).alias("pair_ord", "_p"),
    ).join(chosen, "contract_id", "left")
    currency = F.coalesce("_found", "_currency")
    return read.select(
        "contract_id", F.col("doc_id").alias("sheet"), "pair_ord", "hotel", F.col("_supplier").alias("supplier"),
        F.col("_country").alias("country_code"), F.col("_city").alias("city_area"), F.col("_in").alias("check_in"),
        F.col("_out").alias("check_out"), currency.alias("currency"), currency.alias("customer_currency"),
        F.lit(None).cast("string").alias("room"), F.col("_p.start_date").alias("start_date"),
        F.col("_p.end_date").alias("end_date"), days_inclusive("_p.start_date", "_p.end_date").alias("days"),
        F.lit("Contract").alias("rate_plan"), "meal_plan",
        F.coalesce(blank("_status"), F.lit("Open")).alias("status"), F.array("source_ref").alias("source_refs"),
        F.lit(0.35).alias("confidence"), F.array(F.lit(WARNING)).alias("warnings"),
    )


def text_notes(documents: DataFrame, text: str = "raw_excerpt") -> DataFrame:
    """EX15's notes: trigger notes, plus one for each document without any date pair."""
    read = documents.where(F.coalesce(F.col("classification") != "index_reference", F.lit(True)))
    undated = F.when(F.size(date_pairs("_body")) == 0, _note("Source ambiguity", F.concat(
        F.lit("No date pairs detected on "), "doc_id", F.lit(". Review manually to find rate periods.")
    )))
    return _told(read, text, [*_hits(), undated])


def extract_from_text(
    documents: DataFrame, options: DataFrame, text: str = "raw_excerpt",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EX15: rows, notes and child columns."""
    return text_rows(documents, options, text), text_notes(documents, text), text_child_columns(documents, text)
