"""Row rules. All rules of a row fill one array of issues, so a table is checked in one scan without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import is_blank, once
from tariffmill.functions.dates import days_inclusive
from tariffmill.schemas import DOMAINS, HOTEL_HEADERS, STRICT_CHILD_KEYS

ISSUE = "struct<severity:string,message:string,field:string,quick_fix_type:string>"
NO_ISSUES = f"array<{ISSUE}>"

REQUIRED = ("hotel", "room", "start_date", "end_date")


def _issue(severity: str, message: Column | str, field: Column | str | None = None, fix: str | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    name = F.lit(field) if isinstance(field, str) or field is None else field
    return F.struct(
        F.lit(severity).alias("severity"), text.alias("message"), name.cast("string").alias("field"),
        F.lit(fix).cast("string").alias("quick_fix_type"),
    )


def required_fields() -> list[Column]:
    """V1."""
    return [
        F.when(is_blank(f), _issue("error", f"Required field missing: {HOTEL_HEADERS[f]}", HOTEL_HEADERS[f]))
        for f in REQUIRED
    ]


def date_rules() -> list[Column]:
    """V2: malformed dates and ends before starts. Equal dates are valid."""
    both = ~is_blank("start_date") & ~is_blank("end_date")
    malformed = _issue("error", "Start Date or End Date is malformed", "Start Date")
    turned = _issue("error", "End Date is before or equal to Start Date", "End Date")
    return [F.when(both, once(days_inclusive("start_date", "end_date"), lambda days: (
        F.when(days.isNull(), malformed).when(days <= 0, turned)
    )))]


def currency_rules() -> list[Column]:
    """V3."""
    return [
        F.when(is_blank("currency"), _issue("warning", "Currency missing", "Currency", "set_default_currency")),
        F.when(is_blank("customer_currency"), _issue(
            "warning", "Customer Price Currency missing", "Customer Price Currency", "copy_currency_to_customer"
        )),
    ]


def plan_rules() -> list[Column]:
    """V4."""
    return [
        F.when(is_blank(f), _issue("warning", f"{HOTEL_HEADERS[f]} missing", HOTEL_HEADERS[f]))
        for f in ("rate_type", "rate_plan", "meal_plan")
    ]


def provenance_rules() -> list[Column]:
    """V5: no source reference; confidence below 0.4, an unknown one counting as zero."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    low = F.concat(F.lit("Low confidence ("), F.format_string("%.2f", confidence), F.lit(")"))
    return [
        F.when(F.coalesce(F.size("source_refs") <= 0, F.lit(True)), _issue("warning", "Source reference missing")),
        F.when(confidence < 0.4, _issue("warning", low)),
    ]


def strict_child_keys(mode: Column) -> Column:
    """V6: in strict mode every child key outside the strict layout is flagged."""
    extra = F.filter(F.map_keys("child_values"), lambda k: ~k.isin(*STRICT_CHILD_KEYS))
    flagged = F.transform(extra, lambda k: _issue("warning", F.concat(
        F.lit("Child age band '"), k,
        F.lit("' is not in the strict template. Value will be moved to Extraction Notes on export."),
    ), k))
    return F.when(mode == "strict_template", F.coalesce(flagged, F.array().cast(NO_ISSUES))).otherwise(
        F.array().cast(NO_ISSUES)
    )


RULES = {
    "required_fields": required_fields,
    "dates": date_rules,
    "currencies": currency_rules,
    "plans": plan_rules,
    "provenance": provenance_rules,
}


def row_issues(rows: DataFrame, rules: tuple[str, ...] = tuple(RULES), mode: Column | None = None) -> DataFrame:
    """V1 to V6 over rows, in one projection."""
    checks = [check for rule in rules for check in RULES[rule]()]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast(NO_ISSUES)
    if mode is not None:
        found = F.concat(found, strict_child_keys(mode))
    return rows.select("contract_id", "row_id", "hotel", "sheet", F.inline(found))


def ignored_sheets(documents: DataFrame) -> DataFrame:
    """V7: support sheets are reported as ignored."""
    reason = "Support / policy sheet"
    return documents.where(F.col("classification") == "support_notes").select(
        "contract_id", F.lit(None).cast("string").alias("row_id"), F.lit(None).cast("string").alias("hotel"),
        F.col("doc_id").alias("sheet"), F.lit("info").alias("severity"),
        F.concat(F.lit("Sheet/page ignored: "), "doc_id", F.lit(f" ({reason})")).alias("message"),
        F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("quick_fix_type"),
    )


def validate(rows: DataFrame, options: DataFrame, documents: DataFrame) -> DataFrame:
    """All issues of a contract's rows and sheets."""
    mode = options.select("contract_id", "child_column_mode")
    checked = rows.join(mode, "contract_id", "left")
    return row_issues(checked, mode=F.col("child_column_mode")).unionByName(ignored_sheets(documents))


def domain_violations(rows: DataFrame, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """V9: values outside their pick list. Lists are literals; country codes are checked by shape."""
    domains = DOMAINS if domains is None else domains
    tests = [
        F.when(~is_blank(f) & ~F.col(f).isin(*values), F.struct(F.lit(f).alias("field"), F.col(f).alias("value")))
        for f, values in domains.items() if f in rows.columns
    ]
    if "country_code" in rows.columns:
        odd = ~is_blank("country_code") & ~F.col("country_code").rlike("^[A-Z]{2}$")
        tests.append(F.when(odd, F.struct(F.lit("country_code").alias("field"), F.col("country_code").alias("value"))))
    return rows.select("contract_id", "row_id", F.inline(F.array_compact(F.array(*tests))))


def export_gate(contracts: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF4: contracts without errors may be exported; the others come with their blocking issues."""
    errors = issues.where(F.col("severity") == "error")
    blocked = errors.select("contract_id").distinct()
    return contracts.join(blocked, "contract_id", "left_anti"), errors
