"""Source cells against output rows: which prices were lost, which tables were read too thinly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import is_blank
from tariffmill.functions.dates import mentions_date, names_board, names_room
from tariffmill.functions.numbers import parse_price_cell
from tariffmill.operators.normalize import row_prices
from tariffmill.operators.shaping import keep_top

COLUMN = ["contract_id", "doc_id", "col_name"]


def price_cells(cells: DataFrame) -> DataFrame:
    """Source cells that hold a price, with its value."""
    number = "value_num" if "value_num" in cells.columns else None
    return cells.withColumn("price", parse_price_cell("raw", number)).where(F.col("price").isNotNull())


def mapped_prices(rows: DataFrame) -> DataFrame:
    """Distinct prices per contract over all rows of the contract."""
    return rows.select("contract_id", F.explode(row_prices()).alias("price")).distinct()


def unmapped_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Price cells whose value no row of the contract carries."""
    return price_cells(cells).join(mapped_prices(rows), ["contract_id", "price"], "left_anti")


def audit_stats(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """AG7: cells, mapped values, unmapped cells and rows without prices, per contract.

    Cells are first counted per value, so the join sees each value of a contract once however often it occurs.
    """
    per_value = price_cells(cells).groupBy("contract_id", "price").agg(F.count(F.lit(1)).alias("_cells"))
    known = mapped_prices(rows).withColumn("_known", F.lit(True))
    cell_side = per_value.join(known, ["contract_id", "price"], "left").groupBy("contract_id").agg(
        F.sum("_cells").alias("source_price_cells"),
        F.sum(F.when(F.col("_known").isNull(), F.col("_cells")).otherwise(0)).alias("unmapped_cells"),
    )
    value_side = known.groupBy("contract_id").agg(F.count(F.lit(1)).alias("mapped_price_values"))
    bare = ~is_blank("room") & (F.size(row_prices()) == 0)
    row_side = rows.groupBy("contract_id").agg(F.count_if(F.coalesce(bare, F.lit(False))).alias("rows_without_prices"))
    counts = ["source_price_cells", "mapped_price_values", "unmapped_cells", "rows_without_prices"]
    return (
        row_side.join(value_side, "contract_id", "full").join(cell_side, "contract_id", "full")
        .select("contract_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )


def sample_cells(cells: DataFrame, n: int | None = None) -> DataFrame:
    """ST3: the cells of each source column, or the first ``n`` in reading order with their place."""
    return cells if n is None else keep_top(cells, COLUMN, [F.asc("table_idx"), F.asc("row_idx")], n, rank_as="place")


def unmapped_notes(unmapped: DataFrame, n: int | None = None) -> DataFrame:
    """AG8: one note per source column with the count and, if a caller asks for ``n``, the first samples.

    The cells themselves are ``unmapped``, in long form: a note does not grow with its column.
    """
    counts = unmapped.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("_n"))
    if n is None:
        return _unmapped_text(counts, F.lit(""))
    samples = sample_cells(unmapped, n).groupBy(*COLUMN).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "raw"))),
        lambda s: F.concat(F.lit("'"), s["raw"], F.lit("'")),
    ), ", ").alias("_sample"))
    more = F.when(F.col("_n") > n, F.concat(F.lit(" (+"), (F.col("_n") - n).cast("string"), F.lit(" more)"))).otherwise("")
    return _unmapped_text(counts.join(samples, COLUMN), F.concat(F.lit(": "), "_sample", more))


def _unmapped_text(counts: DataFrame, sample: Column) -> DataFrame:
    return counts.select(
        "contract_id", F.col("doc_id").alias("page"), F.lit("Rate anomaly").alias("category"), F.concat(
            F.lit("Source table on "), "doc_id", F.lit(" column '"), "col_name", F.lit("' contained "),
            F.col("_n").cast("string"), F.lit(" numeric value(s) that no Hotel row used"), sample,
            F.lit(". Cross-check the rate table and add or correct the rows manually if needed."),
        ).alias("note"), F.lit(0.3).alias("confidence"),
    )


def rate_dimensions(cells: DataFrame) -> DataFrame:
    """AG9: room-like columns, distinct date cells and distinct boards of each source table."""
    table = ["contract_id", "doc_id", "table_idx"]

    def period(text: str) -> Column:
        # Six characters are the shortest date; prices and boards are shorter than most patterns are dear.
        return F.when((F.length(text) >= 6) & mentions_date(text), F.regexp_replace(F.btrim(text), r"\s+", " "))

    def fact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    # Cells shrink to a table's distinct facts where they are read; lists of facts are made of these few rows only.
    told = cells.select(*table, "col_name", period("raw").alias("_period"), names_board("raw").alias("_board")).distinct()
    facts = told.select(*table, F.inline(F.array(
        fact("column", F.col("col_name")), fact("period", F.col("_period")), fact("period", period("col_name")),
        fact("board", F.col("_board")), fact("board", names_board("col_name")),
    ))).where((F.col("kind") == "column") | F.col("value").isNotNull()).distinct()
    return facts.groupBy("contract_id", "doc_id", "table_idx").agg(
        F.count_if((F.col("kind") == "column") & names_room("value")).alias("rooms"),
        F.count_if(F.col("kind") == "period").alias("periods"),
        F.count_if(F.col("kind") == "board").alias("boards"),
    )


def completeness_notes(cells: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """AG10: rate tables of contract documents that yielded fewer than half the rows their axes promise."""
    contract_docs = documents.where(F.col("classification") == "hotel_contract").select(
        "contract_id", "doc_id", "source_ref"
    )
    page = r"^Pages?:(\d+)(?:-(\d+))?$"
    first, last = F.regexp_extract("sheet", page, 1), F.regexp_extract("sheet", page, 2)
    paged = F.transform(
        F.sequence(first.try_cast("int"), F.coalesce(F.nullif(last, F.lit("")), first).try_cast("int")),
        lambda p: F.concat(F.lit("Page:"), p.cast("string")),
    )
    docs = F.when(F.col("sheet").rlike(page), paged).otherwise(F.array("sheet"))
    produced = (
        rows.groupBy("contract_id", "sheet").agg(F.count(F.lit(1)).alias("_rows"))
        .select("contract_id", F.explode(docs).alias("doc_id"), "_rows")
        .groupBy("contract_id", "doc_id").agg(F.sum("_rows").alias("actual"))
    )
    sized = (
        rate_dimensions(cells)
        .where((F.col("rooms") >= 2) & (F.col("periods") >= 1) & (F.col("boards") >= 1))
        .join(contract_docs, ["contract_id", "doc_id"])
        .join(produced, ["contract_id", "doc_id"], "left")
        .withColumns({
            "expected": F.col("rooms") * F.col("periods") * F.col("boards"),
            "actual": F.coalesce("actual", F.lit(0)),
        })
        .where(F.col("actual") < F.floor(F.col("expected") * 0.5))
    )
    text = F.concat(
        F.lit("Detected a rate table on "), "doc_id", F.lit(" with "), F.col("rooms").cast("string"),
        F.lit(" room column(s), "), F.col("periods").cast("string"), F.lit(" period(s) and "),
        F.col("boards").cast("string"), F.lit(" board plan(s) — expected up to "), F.col("expected").cast("string"),
        F.lit(" Hotel rows but only "), F.col("actual").cast("string"), F.lit(" were generated ("),
        (F.col("expected") - F.col("actual")).cast("string"),
        F.lit(" missing). Review the source preview and add the missing rows by hand, or re-run with Force Vision and a "
              "different DPI."),
    )
    return sized.select(
        "contract_id", F.col("doc_id").alias("page"), F.lit("Source ambiguity").alias("category"), text.alias("note"),
        "table_idx", "expected", "actual", F.lit(0.3).alias("confidence"),
    )


def expected_grid_notes(skeleton: DataFrame, rows: DataFrame) -> DataFrame:
    """EX20: batches whose rows fall short of rooms x periods x meals.

    ``skeleton`` has one row per batch with its axis counts and layout; period-column layouts have one meal.
    """
    produced = rows.groupBy("contract_id", "batch_id").agg(F.count(F.lit(1)).alias("actual"))
    boards = F.when(F.col("layout_pattern") == "period_column", 1).otherwise(F.greatest("n_meals", F.lit(1)))
    sized = skeleton.join(produced, ["contract_id", "batch_id"], "left").withColumns({
        "expected": (F.col("n_rooms") * F.col("n_periods") * boards).cast("bigint"),
        "actual": F.coalesce("actual", F.lit(0)),
    }).where((F.col("expected") > 0) & (F.col("actual") < F.col("expected")))
    text = F.concat(
        F.lit("Two-call extraction expected "), F.col("expected").cast("string"), F.lit(" rows from the skeleton ("),
        F.col("n_rooms").cast("string"), F.lit(" rooms × "), F.col("n_periods").cast("string"), F.lit(" periods × "),
        F.col("n_meals").cast("string"), F.lit(" meal plans) but produced "), F.col("actual").cast("string"),
        F.lit(". "), (F.col("expected") - F.col("actual")).cast("string"),
        F.lit(" row(s) appear to be missing — check the source preview and fill them in manually."),
    )
    return sized.select(
        "contract_id", "batch_id", "expected", "actual", F.lit("Source ambiguity").alias("category"),
        text.alias("note"), F.lit(0.3).alias("confidence"),
    )
