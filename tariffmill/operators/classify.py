"""What a sheet or page is: index, contract, notes or unknown; and how a PDF should be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import any_contains, count_contained
from tariffmill.functions.dates import mentions_date_or_month
from tariffmill.functions.names import is_index_sheet, is_scrambled
from tariffmill.functions.numbers import parse_plain
from tariffmill.functions.vocabulary import rate_token_hits
from tariffmill.operators.blocks import DOC
from tariffmill.operators.shaping import keep_top
from tariffmill.session import stage

# Hints of index sheets, hotel names, rate headers and notes.
INDEX_NAME_HINTS = ("hotel list", "index", "summary", "contents", "hotels", "table of contents")
HOTEL_WORDS = r"(?iU)\b(hotel|resort|inn|palace|villa|residence|suites|spa|club|riad)\b"
RATE_HEADER_WORDS = (
    "from", "to", "valid from", "valid to", "start", "end", "room", "villa", "pavilion", "bungalow", "suite", "studio",
    "chalet", "cabana", "residence", "rate", "rates", "single", "double", "triple", "child", "chd", "sgl", "dbl", "tpl",
    "extra bed", "supplement", "release", "min stay", "meal", "bb", "hb", "fb", "ai",
)
NOTES_WORDS = (
    "cancellation", "no show", "no-show", "terms", "conditions", "tax", "service charge", "vat", "gala", "christmas",
    "new year", "booking window",
)
CLASS_ORDER = {"hotel_contract": 0, "index_reference": 1}


def _reads_like_hotel(text: Column) -> Column:
    """True for a name of at most 80 characters. Every hotel word has three characters beyond @ in a row, which is cheap to see."""
    return (F.length(text) <= 80) & text.rlike(r"[^\x00-@]{3}") & text.rlike(HOTEL_WORDS)


def detected_hotel_names(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """The first cell (of the first ``rows`` rows) that reads like a hotel's name."""
    text = F.btrim("value_str")
    named = cells.where(_reads_like_hotel(text))
    named = named if rows is None else named.where(F.col("row_idx") < rows)
    return named.groupBy(*DOC).agg(F.min_by(text, F.struct("row_idx", "col_idx")).alias("detected_hotel_name"))


def _header_bits(text: Column) -> Column:
    """One bit for each rate header or notes word that a cell may be, in the order of the lists; 0 for any other cell."""
    words = [*RATE_HEADER_WORDS, *NOTES_WORDS]
    bits = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, 1 << i)])
    return F.when(text.isin(*words), F.element_at(bits, text).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def classify_sheets(cells: DataFrame, cells_read: int | None = None, name_rows: int | None = None) -> DataFrame:
    """Sheets by name hints and by header words among their filled cells, or the first ``cells_read`` of them."""
    trimmed = F.btrim("value_str")
    first = F.when(_reads_like_hotel(trimmed), F.struct("row_idx", "col_idx", trimmed.alias("text")))
    named = first if name_rows is None else F.when(F.col("row_idx") < name_rows, first)
    told = cells.select(*DOC, named.alias("_named"), _header_bits(F.lower(trimmed)).alias("_bits"))
    if cells_read is not None:
        filled = keep_top(cells.where(trimmed != ""), DOC, [F.asc("row_idx"), F.asc("col_idx")], cells_read)
        told = told.select(*DOC, "_named", F.lit(0).cast("bigint").alias("_bits")).unionByName(filled.select(
            *DOC, F.lit(None).cast(told.schema["_named"].dataType).alias("_named"), _header_bits(F.lower(trimmed)).alias("_bits")
        ))
    # One scan: the bits of a sheet's words add up by hash where they are read, names being keys; then names are few.
    counted = told.groupBy(*DOC, "_named").agg(F.bit_or("_bits").alias("_bits")).groupBy(*DOC).agg(
        F.bit_or("_bits").alias("_bits"), F.min("_named")["text"].alias("detected_hotel_name")
    )
    name = F.regexp_replace(F.col("doc_id"), "^Sheet:", "")
    index = any_contains(F.lower(name), INDEX_NAME_HINTS)
    kind = (
        F.when(index, "index_reference").when(F.col("rate_hits") >= 3, "hotel_contract")
        .when(name.rlike(HOTEL_WORDS), "hotel_contract")
        .when((F.col("note_hits") >= 3) & (F.col("rate_hits") < 2), "support_notes").otherwise("unknown")
    )
    rates = (1 << len(RATE_HEADER_WORDS)) - 1
    return counted.select(
        *DOC, F.bit_count(F.col("_bits").bitwiseAND(F.lit(rates))).cast("bigint").alias("rate_hits"),
        F.bit_count(F.shiftright("_bits", len(RATE_HEADER_WORDS))).cast("bigint").alias("note_hits"), "detected_hotel_name",
    ).withColumn("classification", kind).withColumn(
        "detected_hotel_name", F.when(~index, F.col("detected_hotel_name"))
    ).select(*DOC, "rate_hits", "note_hits", "detected_hotel_name", "classification")


def classify_pages(pages: DataFrame) -> DataFrame:
    """Pages by words anywhere in their text; a table lowers the bar to one rate word."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rate, note = count_contained(text, RATE_HEADER_WORDS), count_contained(text, NOTES_WORDS)
    kind = (
        F.when((F.col("rate_hits") >= 3) | ((F.col("n_tables") > 0) & (F.col("rate_hits") >= 1)), "hotel_contract")
        .when(F.col("note_hits") >= 3, "support_notes").otherwise("unknown")
    )
    return pages.withColumns({"rate_hits": rate, "note_hits": note}).withColumn("classification", kind)


def outline_hotels(sheets: DataFrame) -> DataFrame:
    """Every sheet that is no index is a hotel; a contract with several is multi-hotel."""
    hotels = sheets.where(~is_index_sheet("name")).select(
        "contract_id", F.col("name").alias("hotel"), F.concat(F.lit("Sheet:"), "name").alias("source_hint"), "ord"
    )
    counts = hotels.groupBy("contract_id").agg((F.count(F.lit(1)) > 1).alias("is_multi_hotel"))
    return hotels.join(counts, "contract_id")


def page_vision_flags(pages: DataFrame) -> DataFrame:
    """T4: which pages need reading as images, and why."""
    empty = (F.length(F.btrim(F.coalesce("text", F.lit("")))) < 20) & (F.col("n_tables") == 0)
    thin = (F.col("rate_token_hits") >= 3) & ~F.col("has_numeric_table")
    reasons = F.array_compact(F.array(
        F.when(empty, "empty_page"), F.when(F.col("scrambled"), "scrambled_text"),
        F.when(thin, "rate_tokens_without_numeric_table"),
    ))
    flagged = pages.withColumns({"scrambled": is_scrambled("text"), "rate_token_hits": rate_token_hits("text")})
    return flagged.withColumn("vision_reasons", reasons).withColumn("needs_vision", F.size("vision_reasons") > 0)


def numeric_tables(cells: DataFrame, page_keys: list[str]) -> DataFrame:
    """FN28: pages whose tables hold both a number of at least 5 and a date or month."""
    text = F.btrim("raw")
    number = parse_plain(F.btrim(F.translate(text, ",€$", "")))
    dated = number.isNull() & F.coalesce(mentions_date_or_month(text), F.lit(False))
    return cells.groupBy(*page_keys).agg(
        (F.bool_or(F.coalesce(F.abs(number) >= 5, F.lit(False))) & F.bool_or(dated)).alias("has_numeric_table")
    )


def pdf_strategy(pages: DataFrame, mode: Column | str = "auto", contracts: DataFrame | None = None) -> DataFrame:
    """AG21: how each contract's PDF is read. ``mode`` text_only and vision_required overrule the counts.

    ``contracts`` (contract_id) adds those without any page, which have text only.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    empty = (F.length(F.btrim(F.coalesce("text", F.lit("")))) < 20) & (F.col("n_tables") == 0)
    thin = (F.col("rate_token_hits") >= 3) & ~F.col("has_numeric_table")
    counted = pages.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(empty).alias("empty_pages"),
        F.count_if("scrambled").alias("scrambled_pages"), F.count_if(thin).alias("pages_without_table"),
        F.bool_or("has_numeric_table").alias("useful_tables"), F.sum("rate_token_hits").alias("token_hits"),
    )
    mostly_empty = F.col("empty_pages") >= F.greatest(F.lit(1), F.floor(F.col("pages") * 0.6))
    strategy = (
        F.when(mode == "text_only", "native_text_llm").when(mode == "vision_required", "vision_only")
        .when(mostly_empty, "vision_only")
        .when((F.col("scrambled_pages") > 0) | (F.col("pages_without_table") > 0), "two_call_vision")
        .when(F.col("useful_tables") & (F.col("token_hits") >= 3), "native_text_llm").otherwise("two_call_vision")
    )
    decided = counted.withColumn("strategy", strategy)
    if contracts is None:
        return decided
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("pages", "empty_pages", "scrambled_pages", "pages_without_table", "token_hits")}
    return contracts.select("contract_id").distinct().join(decided, "contract_id", "left").withColumns({
        **counts, "useful_tables": F.coalesce("useful_tables", F.lit(False)), "strategy": F.coalesce("strategy", F.lit("native_text_llm")),
    })


def sheet_summary(documents: DataFrame) -> DataFrame:
    """T5."""
    return documents.select(
        "contract_id", "doc_id", "kind", "classification", "detected_hotel_name", "source_ref"
    )


def class_priority(classification: Column | str) -> Column:
    """ST4's order: contracts, then index sheets, then the rest."""
    c = F.col(classification) if isinstance(classification, str) else classification
    return F.when(c == "hotel_contract", 0).when(c == "index_reference", 1).otherwise(2)


def priority_documents(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """ST4: documents with their ``priority`` (class, then ``ord``, is a contract's reading order), or its first ``limit``."""
    ranked = documents.withColumn("priority", class_priority("classification"))
    return ranked if limit is None else keep_top(ranked, ["contract_id"], [F.asc("priority"), F.asc("ord")], limit)


# What one document may hold in one request to a model, by file kind: characters, table rows, table columns.
REQUEST_DOCUMENTS = 40
FORMAT_CAPS = {
    "xlsx": (60000, 1000, 100),
    "xls": (60000, 1000, 100),
    "pdf": (10000, 120, 40),
    "docx": (12000, 200, 40),
    "image": (8000, 120, 40),
    "mixed": (12000, 200, 40),
    "unknown": (8000, 200, 40),
}


def _cap(kind: Column, index: int, formats: dict[str, tuple[int, int, int]]) -> Column:
    chain = None
    for name, caps in formats.items():
        test = F.lower(kind) == name
        chain = F.when(test, caps[index]) if chain is None else chain.when(test, caps[index])
    return chain.otherwise(formats["unknown"][index])


def trim_for_budget(
    documents: DataFrame, cells: DataFrame, limit: int | None = None, formats: dict[str, tuple[int, int, int]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """PF12: documents and cells of one request: the first ``limit`` documents of a contract, and of each the characters,
    rows and columns that ``formats`` (such as ``FORMAT_CAPS``) grants its kind. Without them nothing is cut.
    """
    kept = priority_documents(documents, limit)
    if formats is None:
        named = cells.where(" AND ".join(f"{c} IS NOT NULL" for c in DOC))
        # Cells move only if some leave: their sheets, one short row each, tell that first.
        lost = stage(named.select(*DOC).distinct().join(kept.select(*DOC), DOC, "left_anti"))
        return kept, named if lost.isEmpty() else named.join(kept.select(*DOC), DOC, "left_semi")
    shown = _cap(F.col("input_format"), 0, formats)
    trimmed = kept.withColumn("raw_excerpt", F.when(
        F.length("raw_excerpt") > shown,
        F.concat(F.substring(F.col("raw_excerpt"), F.lit(1), shown), F.lit("\n...[truncated]")),
    ).otherwise(F.col("raw_excerpt")))
    kinds = kept.select(*DOC, "input_format")
    inside = cells.join(kinds, DOC).where(
        (F.col("row_idx") < _cap(F.col("input_format"), 1, formats)) & (F.col("col_idx") < _cap(F.col("input_format"), 2, formats))
    ).drop("input_format")
    return trimmed, inside
