"""Review: filters, counts, badges, and the edits reviewers make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, first_filled
from tariffmill.operators.shaping import first_by

UNKNOWN_HOTEL = "Unknown Hotel"
# Note categories that describe supplements.
SUPPLEMENT_CATEGORIES = ("Room supplement", "Taxes/service", "Meal plan nuance")


def _hotel() -> Column:
    return F.coalesce(blank("hotel"), F.lit(UNKNOWN_HOTEL))


def row_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("row_id").isNotNull()).groupBy("contract_id", "row_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings_count"),
    )


def join_issue_counts(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows with their numbers of errors and warnings."""
    return rows.join(row_issue_counts(issues), ["contract_id", "row_id"], "left").withColumns({
        "errors": F.coalesce("errors", F.lit(0)), "warnings_count": F.coalesce("warnings_count", F.lit(0)),
    })


def filter_rows(
    rows: DataFrame, issues: DataFrame, hotel: str = "", sheet: str = "", only_errors: bool = False,
    only_warnings: bool = False,
) -> DataFrame:
    """PF5: the review grid's filters. Text filters apply before the join to issue counts."""
    kept = rows
    if hotel:
        kept = kept.where(F.coalesce("hotel", F.lit("")).contains(hotel))
    if sheet:
        kept = kept.where(F.coalesce("sheet", F.lit("")).contains(sheet))
    for wanted, severity in ((only_errors, "error"), (only_warnings, "warning")):
        if wanted:
            marked = issues.where(F.col("severity") == severity).select("contract_id", "row_id").distinct()
            kept = kept.join(marked, ["contract_id", "row_id"], "left_semi")
    return kept


def filter_notes(notes: DataFrame, text: str = "", category: str = "") -> DataFrame:
    """PF6."""
    kept = notes
    if text:
        kept = kept.where(F.lower(F.coalesce("note", F.lit(""))).contains(text.lower()))
    return kept.where(F.col("category") == category) if category else kept


def bucket_notes(notes: DataFrame) -> DataFrame:
    """PF7: notes as supplements, offers or cancellation; the rest have no bucket."""
    return notes.withColumn(
        "bucket",
        F.when(F.col("category").isin(*SUPPLEMENT_CATEGORIES), "supplements")
        .when(F.col("category") == "Special offer", "offers").when(F.col("category") == "Cancellation", "cancellation"),
    )


def field_state(rows: DataFrame, field: str) -> DataFrame:
    """PF11: badge of one field: enriched, edited, verify or none."""
    meta = F.try_element_at("cell_meta", F.lit(field))
    named = F.exists("warnings", lambda w: w.contains(field))
    state = (
        F.when(F.coalesce(meta["ai_inferred"], F.lit(False)), "enriched")
        .when(F.coalesce(meta["user_edited"], F.lit(False)), "edited")
        .when(F.coalesce(named, F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) < 0.4), "verify").otherwise("none")
    )
    return rows.withColumn("field_state", state)


def sheet_overview(documents: DataFrame, rows: DataFrame, notes: DataFrame) -> DataFrame:
    """AG14: per sheet its class, first hotel and numbers of rows and notes."""
    per_sheet = rows.groupBy("contract_id", F.col("sheet").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("rows"), first_by("hotel").alias("hotel")
    )
    per_page = notes.groupBy("contract_id", F.col("page").alias("doc_id")).agg(F.count(F.lit(1)).alias("notes"))
    shown = F.when(F.col("classification").isin("hotel_contract", "index_reference"), F.col("classification"))
    return documents.join(per_sheet, ["contract_id", "doc_id"], "left").join(
        per_page, ["contract_id", "doc_id"], "left"
    ).select(
        "contract_id", "doc_id", F.coalesce(shown, F.lit("other")).alias("classification"),
        F.coalesce("hotel", F.lit("—")).alias("hotel"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("notes", F.lit(0)).alias("notes"),
    )


def summary_cards(
    documents: DataFrame, rows: DataFrame, columns: DataFrame, notes: DataFrame, issues: DataFrame,
) -> DataFrame:
    """AG15: one row of headline numbers per contract. Every table is counted before the join."""
    def counted(df: DataFrame, **aggs: Column) -> DataFrame:
        return df.groupBy("contract_id").agg(*[c.alias(n) for n, c in aggs.items()])

    parts = [
        counted(
            documents, hotel_sheets=F.count_if(F.col("classification") == "hotel_contract"),
            index_sheets=F.count_if(F.col("classification") == "index_reference"), sheets=F.count(F.lit(1)),
        ),
        counted(
            rows, hotel_rows=F.count(F.lit(1)),
            avg_confidence=F.round(F.sum(F.coalesce("confidence", F.lit(0.0)).cast("decimal(18,4)")) / F.count(F.lit(1)), 2),
        ),
        counted(columns, child_columns=F.count(F.lit(1))),
        counted(notes, notes=F.count(F.lit(1))),
        counted(
            issues, errors=F.count_if(F.col("severity") == "error"), warnings=F.count_if(F.col("severity") == "warning"),
        ),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "contract_id", "full")
    zero = [
        "hotel_sheets", "index_sheets", "sheets", "hotel_rows", "child_columns", "notes", "errors", "warnings",
    ]
    return joined.select("contract_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "avg_confidence")


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """AG16: numbers of issues per severity."""
    return issues.where(F.col("severity").isin("error", "warning", "info")).groupBy("contract_id", "severity").agg(
        F.count(F.lit(1)).alias("issues")
    )


def grouped_issues(issues: DataFrame) -> DataFrame:
    """AG16's groups in long form: every issue of the three severities with the ``group_rank`` of its own."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2)
    return issues.withColumn("group_rank", rank).where(F.col("group_rank").isNotNull())


def season_overview(rows: DataFrame) -> DataFrame:
    """AG17: distinct date spans with the first row's name, weekdays, minimum stay and release."""
    first = F.struct(
        F.coalesce(first_filled("season", "rate_plan"), F.lit("")).alias("name"), F.coalesce("days", F.lit("")).alias("days"),
        "min_stay", "release_period",
    )
    return rows.groupBy(
        "contract_id", F.coalesce("start_date", F.lit("")).alias("start_date"),
        F.coalesce("end_date", F.lit("")).alias("end_date"),
    ).agg(F.min_by(first, F.col("ord")).alias("_f"), F.min("ord").alias("first_ord")).select(
        "contract_id", "start_date", "end_date", "_f.*", "first_ord"
    )


def room_overview(rows: DataFrame) -> DataFrame:
    """AG18: distinct rooms with the first row's bed type and limits."""
    first = F.struct(
        F.coalesce("hotel", F.lit("")).alias("hotel"), F.coalesce("bed_type", F.lit("")).alias("bed_type"), "min_adult",
        "max_adult", "max_pax", "max_rollaways", "max_cribs",
    )
    return rows.groupBy("contract_id", F.coalesce(blank("room"), F.lit("(unnamed room)")).alias("room")).agg(
        F.min_by(first, F.col("ord")).alias("_f"), F.min("ord").alias("first_ord")
    ).select("contract_id", "room", "_f.*", "first_ord")


def distinct_counts(rows: DataFrame) -> DataFrame:
    """AG19: numbers of distinct rooms (a missing name counts as one), meals and hotels."""
    facts = rows.select("contract_id", F.inline(F.array(
        F.struct(F.lit("room").alias("kind"), F.col("room").alias("value")),
        F.struct(F.lit("meal").alias("kind"), blank("meal_plan").alias("value")),
        F.struct(F.lit("hotel").alias("kind"), _hotel().alias("value")),
    ))).distinct()
    return facts.groupBy("contract_id").agg(
        F.count_if(F.col("kind") == "room").alias("rooms"),
        F.count_if((F.col("kind") == "meal") & F.col("value").isNotNull()).alias("meals"),
        F.count_if(F.col("kind") == "hotel").alias("hotels"),
    )


def export_summary(rows: DataFrame, notes: DataFrame, columns: DataFrame) -> DataFrame:
    """AG20: numbers of rows, notes and child columns of an export, with its number of headers."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("contract_id").agg(F.count(F.lit(1)).alias(name))

    joined = counted(rows, "hotel_rows").join(counted(notes, "notes"), "contract_id", "full").join(
        counted(columns, "child_columns"), "contract_id", "full"
    )
    names = ["hotel_rows", "notes", "child_columns"]
    filled = joined.select("contract_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return filled.withColumn("headers", F.lit(48) + F.col("child_columns"))


def first_seen_hotels(rows: DataFrame) -> DataFrame:
    """Hotels with the place of their first row."""
    return rows.groupBy("contract_id", _hotel().alias("hotel")).agg(F.min("ord").alias("first_ord"))


# Edits: contract_id, grain (hotel, room, season, row), hotel, room, start_date, end_date, row_id, field, value, at.
EDIT_GRAINS = {
    "hotel": ("_hotel",),
    "room": ("_hotel", "room"),
    "season": ("start_date", "end_date"),
    "row": ("row_id",),
}


def _later(first: Column, second: Column) -> Column:
    """The edit (at, ord, value) made later; the first where both were made at once."""
    def made(edit: Column) -> Column:
        return F.struct(edit["at"], edit["ord"])

    return F.when(second.isNull(), first).when(first.isNull() | (made(second) > made(first)), second).otherwise(first)


def patch_fields(rows: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """reviewers' edits, the latest per field winning whatever its grain.

    Edits are first reduced to the latest per target and field, then folded into one row per target, so each grain costs
    one join. Only the latest edit so far of each field goes on with a row, from the finest grain, which few rows have, to
    hotels; of edits made at once the finer one counts. Hotel edits also mark the field as edited by hand.
    """
    patched = rows.withColumn("_hotel", _hotel())
    targeted = edits.withColumn("_hotel", _hotel())
    for grain, keys in reversed(EDIT_GRAINS.items()):
        mine = targeted.where((F.col("grain") == grain) & F.col("field").isin(*fields))
        latest = mine.groupBy("contract_id", *keys).agg(
            *[F.max(F.when(F.col("field") == f, F.struct("at", "ord", "value"))).alias(f"_new_{f}") for f in fields]
        )
        renamed = latest.select(
            F.col("contract_id").alias("_c"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_new_{f}" for f in fields]
        )
        condition = F.col("contract_id") == F.col("_c")
        for k in keys:
            same = F.col(k) == F.col(f"_k_{k}") if k == "_hotel" else F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            condition = condition & same
        patched = patched.join(renamed, condition, "left")
        made = {f"_best_{f}": _later(F.col(f"_best_{f}"), F.col(f"_new_{f}")) if f"_best_{f}" in patched.columns else F.col(f"_new_{f}")
                for f in fields}
        if grain == "hotel":
            made |= {f"_by_hotel_{f}": F.col(f"_new_{f}").isNotNull() for f in fields}
        patched = patched.withColumns(made).drop("_c", *[f"_k_{k}" for k in keys], *[f"_new_{f}" for f in fields])
    changes = {f: F.when(F.col(f"_best_{f}").isNull(), F.col(f)).otherwise(F.col(f"_best_{f}.value")) for f in fields}
    touched = F.coalesce(*[F.col(f"_best_{f}") for f in fields]).isNotNull()
    marks = F.array_compact(F.array(*[F.when(F.col(f"_by_hotel_{f}"), F.lit(f)) for f in fields]))
    mark = F.map_from_arrays(F.col("_marks"), F.transform("_marks", lambda m: F.struct(
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source_ref"),
        F.lit(None).cast("boolean").alias("ai_inferred"), F.lit(True).alias("user_edited"),
    )))
    kept = F.map_filter("cell_meta", lambda k, v: ~F.array_contains("_marks", k))
    return patched.withColumn("_marks", marks).withColumns({
        **changes,
        "review_state": F.when(touched, "edited").otherwise(F.col("review_state")),
        "cell_meta": F.when(F.size("_marks") > 0, F.map_concat(kept, mark)).otherwise(F.col("cell_meta")),
    }).select(*rows.columns)


def delete_rows(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows of deleted seasons, rooms and meal plans leave.

    ``deletes`` has ``contract_id, kind (season, room, meal), start_date, end_date, value``.
    """
    seasons = deletes.where(F.col("kind") == "season").select(
        F.col("contract_id").alias("_c"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e")
    ).distinct()
    kept = rows.join(
        seasons,
        (F.col("contract_id") == F.col("_c")) & F.col("start_date").eqNullSafe(F.col("_s"))
        & F.col("end_date").eqNullSafe(F.col("_e")), "left_anti",
    )
    for kind, field in (("room", "room"), ("meal", "meal_plan")):
        gone = deletes.where(F.col("kind") == kind).select("contract_id", F.col("value").alias(field)).distinct()
        kept = kept.join(gone, ["contract_id", field], "left_anti")
    return kept


def quick_fixes(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """The one-click fixes of a row's issues."""
    fixes = issues.where(F.col("quick_fix_type").isNotNull() & F.col("row_id").isNotNull()).groupBy(
        "contract_id", "row_id"
    ).agg(F.collect_set("quick_fix_type").alias("_fixes"))

    def has(fix: str) -> Column:
        return F.coalesce(F.array_contains("_fixes", fix), F.lit(False))

    currency = F.when(has("set_default_currency"), F.coalesce("currency", F.lit("EUR"))).otherwise(F.col("currency"))
    return rows.join(fixes, ["contract_id", "row_id"], "left").withColumns({
        "currency": currency,
        "customer_currency": F.when(has("copy_currency_to_customer"), currency).otherwise(F.col("customer_currency")),
        "supplier": F.when(has("set_default_supplier"), F.coalesce("supplier", F.lit("Unknown Supplier"))).otherwise(
            F.col("supplier")
        ),
        "days": F.when(has("set_all_weekdays"), "0,1,2,3,4,5,6").otherwise(F.col("days")),
    }).drop("_fixes")


def active_rows(original: DataFrame, edited: DataFrame) -> DataFrame:
    """A contract's edited rows where there are any, else its original rows."""
    changed = edited.select("contract_id").distinct()
    return original.join(changed, "contract_id", "left_anti").unionByName(edited, allowMissingColumns=True)


def flatten_child_policies(hotels: DataFrame) -> DataFrame:
    """SO5: the hotels' child policies with their hotel's name."""
    return hotels.select("contract_id", "hotel", F.inline_outer("child_policies"))
