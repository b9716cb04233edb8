"""Sheets of cells: rate blocks, grid text, and the expansion of price grids into rate rows.

Cells are in long form, one row per cell: ``contract_id, doc_id, row_idx, col_idx, value_str, value_num, value_type``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffmill.functions.base import any_contains, blank, count_contained, fold, is_blank, once, stripped
from tariffmill.functions.dates import ALL_WEEK, normalize_iso_date
from tariffmill.functions.names import room_match_score, room_tokens
from tariffmill.functions.numbers import to_float, to_int
from tariffmill.functions.pricing import child_key, money, reduced_price, single_price
from tariffmill.functions.vocabulary import meal_from_treatment
from tariffmill.operators.normalize import apply_meta, clear_child_values
from tariffmill.operators.containment import contained_pairs, strictly_inside
from tariffmill.operators.shaping import CHUNK_CHARACTERS, carry_forward, gathered_text, group_product, last_row
from tariffmill.schemas import CELL_META, MONEY
from tariffmill.session import stage

DOC = ["contract_id", "doc_id"]
# Sheet rows that are placed together.
ROWS_PER_STRETCH = 1_024
# Sheet rows whose cells are sent to one task.
ROWS_PER_DEAL = 8_192
# Rows of a side up to which a sheet is worked on as a whole, in the task it is dealt to.
CELLS_PER_SHEET = 20_000
FACTS_PER_SHEET = 200

# Words that open a rate block, and words of column header rows.
BLOCK_MARKERS = (
    "contract rate", "booking window", "early booking", "ebd", "spo", "special offer", "promotion", "winter season",
    "summer season", "shoulder season", "high season", "low season",
)
COLUMN_HEADER_WORDS = (
    "from", "to", "release", "supplement", "reduction", "1st child", "2nd child", "3rd child", "extra adult",
    "child policy", "room type", "occupancies", "min pax", "max pax", "min adults", "max adults",
)


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_stretch", F.floor(F.col("row_idx") / ROWS_PER_DEAL)).repartition(*DOC, "_stretch")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Cells as sheet rows: their cells in column order, their joined text, and whether they open a rate block.

    A row holds at most the sheet format's 16,384 columns. Cells are dealt by their sheet's stretch of rows (``_stretch``)
    before they are gathered: gathering on the sending side would sort and spill them all, and later steps by stretch
    find the rows in place.
    """
    filled = cells.where(F.col("value_str").isNotNull()).select(
        *DOC, "row_idx", "col_idx", "value_str", F.coalesce(F.abs("value_num").between(5, 50000), F.lit(False)).alias("_counts"))
    rows = _dealt(filled).groupBy(*DOC, "_stretch", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "value_str"))).alias("cells"),
        F.count_if("_counts").alias("numbers"),
        F.count_if(F.btrim("value_str") != "").alias("filled"),
    ).withColumn("text", F.lower(F.array_join(F.transform("cells", lambda c: c["value_str"]), " | ")))
    column_header = (F.col("filled") >= 5) & (count_contained(F.col("text"), COLUMN_HEADER_WORDS) >= 2)
    marker = any_contains(F.col("text"), BLOCK_MARKERS) | F.col("text").rlike("(^|[^a-z0-9])bw([^a-z0-9]|$)")
    opens = (F.btrim("text") != "") & (F.col("numbers") < 3) & ~column_header & marker
    return rows.withColumn("opens_block", opens)


def rate_blocks(cells: DataFrame, sheets: DataFrame | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """The rows of each rate block. Rows above the first block are repeated in every block of their sheet.

    ``line`` is the row's 1-based place in its block's own sheet. A sheet without block rows is one block, and so is
    every sheet that ``sheets`` (the output of ``classify_sheets``) does not call a contract. Openings are carried forward
    stretch by stretch (``carry_forward``), so a long sheet's rows are placed by many tasks. The rows are
    gathered once and written; ``keep`` names what goes along with them, their ``cells`` unless it says otherwise.
    """
    keep = {"cells": F.col("cells")} if keep is None else keep
    title = F.when(F.col("opens_block"), F.btrim("text"))
    rows = stage(sheet_rows(cells).select(*DOC, "_stretch", "row_idx", title.alias("_title"), *[c.alias(n) for n, c in keep.items()]))
    mark = F.when(F.col("_title").isNotNull(), F.struct(F.col("row_idx").alias("start"), F.col("_title").alias("title")))
    if sheets is None:
        carried = carry_forward(rows, DOC, "row_idx", mark, "_block")
    else:
        facts = sheets.select(*DOC, "classification", "detected_hotel_name")
        carried = carry_forward(rows, DOC, "row_idx", mark, "_block", groups=facts, gate=F.col("classification") == "hotel_contract")
    placed = stage(carried.select(
        *[c for c in carried.columns if c not in ("_title", "_stretch", "_block", "_block_first")], F.col("_block.title").alias("title"),
        F.col("_block.start").alias("_start"), F.col("_block_first.start").alias("_first"),
    ))
    openings = placed.where(F.col("_start") == F.col("row_idx")).select(*DOC, F.col("_block_no").alias("_b"), F.col("title").alias("_t"))
    is_above = (F.col("_block_no") == 0) & (F.col("_block_count") > 0)
    above = group_product(placed.where(is_above), openings, DOC, ["row_idx"]).withColumns({
        "_block_no": F.col("_b"), "title": F.col("_t"), "is_preamble": F.lit(True), "line": F.col("row_idx") + 1,
    }).drop("_b", "_t")
    own = placed.where(~is_above).withColumns({
        "is_preamble": F.lit(False),
        "line": F.coalesce(F.col("_first") + F.col("row_idx") - F.col("_start"), F.col("row_idx")) + 1,
    })
    kept = ["classification", "detected_hotel_name"] if sheets is not None else []
    return own.unionByName(above).select(
        *DOC, *kept, "row_idx", F.greatest(F.col("_block_no") - 1, F.lit(0)).alias("block_idx"), "title", "is_preamble",
        "line", F.nullif("_block_count", F.lit(0)).alias("block_count"), *keep,
    )


def column_letter(index: Column) -> Column:
    """A, B, ... Z, AA, ... XFD for a 0-based column index."""
    def letter(n: Column) -> Column:
        return F.when(n >= 0, F.char(n.cast("int") + 65)).otherwise("")

    first = F.floor((index - 26 - 676) / 676)
    second = F.floor((index - 26) / 26)
    return F.concat(
        F.when(index >= 702, letter(first)).otherwise(""),
        F.when(index >= 702, letter(F.pmod(second, F.lit(26)))).when(index >= 26, letter(second)).otherwise(""),
        letter(F.pmod(index, F.lit(26))),
    )


def _clean(text: Column) -> Column:
    """A cell's text with tabs and line breaks flattened."""
    flat = F.translate(text, "\t", " ")
    return stripped(F.when(flat.contains("\n"), F.regexp_replace(flat, "\r?\n", " / ")).otherwise(flat))


def _body(cells: Column) -> Column:
    """Non-blank cells (column, text), in column order, with a tab for each column from the first one to the last used."""
    def column(i: Column) -> Column:
        return F.coalesce(F.get(cells, i)["col_idx"], F.lit(0))

    return F.array_join(F.transform(cells, lambda c, i: F.concat(F.repeat(F.lit("\t"), c["col_idx"] - column(i - 1)), c["text"])), "")


def _used(cells: Column) -> Column:
    return F.coalesce(F.get(cells, F.size(cells) - 1)["col_idx"] + 1, F.lit(0))


def _line(number: Column, body: Column, used: Column, width: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\t"), body, F.repeat(F.lit("\t"), width - used))


def _shown(cells: DataFrame) -> DataFrame:
    """Cells that show something. A line break shows as a slash, so the test needs no cleaned text, which is made once."""
    filled = (stripped("value_str") != "") | F.col("value_str").contains("\n")
    return cells.where(filled).select(*DOC, "row_idx", "col_idx", _clean(F.col("value_str")).alias("text"))


def _rendered(dealt: DataFrame) -> DataFrame:
    """Rows of a sheet that are not blank, where their dealt cells are (``_stretch``): ``line``, ``_body`` and ``_used``.

    The hash stands first because sorting goes by the first key's prefix, which many rows of a contract share.
    """
    return dealt.groupBy(F.xxhash64(*DOC, "row_idx").alias("_hash"), *DOC, "_stretch", "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "text"))).alias("_cells")
    ).select(*DOC, "_stretch", (F.col("row_idx") + 1).alias("line"), _body(F.col("_cells")).alias("_body"), _used(F.col("_cells")).alias("_used"))


def _rendered_rows(shown: DataFrame) -> DataFrame:
    return _rendered(_dealt(shown))


def grid_lines(cells: DataFrame) -> DataFrame:
    """EX16's lines: each non-blank row as its number and its cells, tab separated, up to the sheet's last used column.

    Widths are counted where the cells were dealt and go to each stretch of the sheet, so the cells are made and dealt once
    and the rows stay where their cells went.
    """
    # The join's test for nulls at the head, and row and text named by the widths: both uses of the cells share one exchange.
    dealt = _dealt(_shown(cells)).where(" AND ".join(f"{c} IS NOT NULL" for c in (*DOC, "_stretch")))
    own = F.max(F.when((F.length("text") > 0) & F.col("row_idx").isNotNull(), F.col("col_idx") + 1))
    widths = dealt.groupBy(*DOC, "_stretch").agg(own.alias("_own")).select(
        *DOC, "_stretch", F.max("_own").over(Window.partitionBy(*DOC)).alias("width")
    )
    return _rendered(dealt).join(widths, [*DOC, "_stretch"]).select(
        *DOC, "line", "width", _line(F.col("line"), F.col("_body"), F.col("_used"), F.col("width")).alias("text")
    )


def _heading(name: str, width: Column) -> tuple[Column, Column]:
    """A text's first two lines, and their length as arithmetic on the number of columns."""
    letters = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), column_letter), "\t")
    opening = F.concat(F.lit("=== Sheet: "), F.regexp_replace(name, "^Sheet:", ""), F.lit(" ===\nRow\t"))
    lettered = width + F.greatest(width - 26, F.lit(0)) + F.greatest(width - 702, F.lit(0))
    return F.concat(opening, letters), F.length(opening) + lettered + width - 1


def grid_text(rows: DataFrame, group: list[str], name: str, characters: int = CHUNK_CHARACTERS, facts: Sequence[str] = ()) -> DataFrame:
    """EX16: rendered rows as texts in chunks of about ``characters``: ``group``, ``facts``, chunk from 0, text.

    The chunks of a group, one after the other, are its whole text, headings first. No value grows with a sheet. ``rows``
    (``line``, ``_body``, ``_used``) are dealt by ``group`` and ``_stretch``. A stretch is summed up in one short row, from
    which the group's width and the stretch's offset come, so the rows move only once more, to their chunk. A line
    belongs to the chunk in which it begins. ``facts`` are the same in all rows of a group.
    """
    stretch = [*group, "_stretch"]
    # All but the tabs up to the width; with the line break before and the tab after the number.
    own = (F.length(F.col("line").cast("string")) + F.length("_body") - F.col("_used") + 2).cast("bigint")
    # The joins' test for nulls at the head, and facts among the keys: both uses of the rows then share one exchange.
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in stretch))
    sums = rows.groupBy(*stretch, *facts).agg(F.sum(own).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max("_used").alias("_max"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    seen = sums.select(*stretch, F.max("_max").over(whole).cast("bigint").alias("width"), *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_sum", "_n")
    ])
    heading, length = _heading(name, F.col("width"))
    offsets = seen.select(*stretch, "width", (length + F.col("_sum_before") + F.col("_n_before") * F.col("width")).alias("_before"),
                          (F.col("_n_before") == 0).alias("_top"))
    inside = Window.partitionBy(*stretch).orderBy("line")
    started = rows.join(offsets, stretch).withColumns({
        "_start": F.col("_before") + F.coalesce(F.sum(own + F.col("width")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_top": F.col("_top") & (F.row_number().over(inside) == 1),
    })

    def piece(line: Column, chunk: Column, text: Column) -> Column:
        return F.struct(line.cast("bigint").alias("line"), chunk.alias("chunk"), text.alias("text"))

    text = F.concat(F.lit("\n"), _line(F.col("line"), F.col("_body"), F.col("_used"), F.col("width").cast("int")))
    own_piece = piece(F.col("line"), F.floor(F.col("_start") / characters), text)
    top_piece = piece(F.lit(0), F.lit(0).cast("bigint"), heading)
    pieces = started.select(*group, *facts, F.inline(F.when(F.col("_top"), F.array(top_piece, own_piece)).otherwise(F.array(own_piece))))
    return gathered_text(pieces, group, "line", facts)


def sheet_text(cells: DataFrame, characters: int = CHUNK_CHARACTERS) -> DataFrame:
    """EX16 for whole sheets, in chunks."""
    return grid_text(_rendered_rows(_shown(cells)), DOC, "doc_id", characters)


def _block_rows(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    name = F.when(F.col("title").isNull(), F.col("doc_id")).otherwise(
        F.concat("doc_id", F.lit(" | "), "title")
    )
    shown = F.filter(
        F.transform("cells", lambda c: F.struct(c["col_idx"].alias("col_idx"), _clean(c["value_str"]).alias("text"))),
        lambda c: c["text"] != "",
    )
    rendered = {"_body": once(shown, _body), "_used": once(shown, _used)}
    return rate_blocks(cells, sheets, rendered).where(F.col("_used") > 0).withColumn("block_doc_id", name)


BLOCK = [*DOC, "block_idx", "block_doc_id"]


def block_lines(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """EX17's lines, keyed by document, block and ``line``. Rows are rendered before they are repeated in blocks.

    A block's width comes by join from an aggregate, so no task holds a whole block for it.
    """
    rows = _block_rows(cells, sheets)
    widths = rows.groupBy(*BLOCK).agg(F.max("_used").alias("width"))
    text = _line(F.col("line"), F.col("_body"), F.col("_used"), F.col("width"))
    return rows.join(widths, BLOCK).select(
        *BLOCK, "classification", "detected_hotel_name", F.col("title").alias("block_title"), "block_count", "line", "width", text.alias("text"),
    )


def block_documents(cells: DataFrame, sheets: DataFrame, characters: int = CHUNK_CHARACTERS) -> DataFrame:
    """EX17: one document per rate block of contract sheets, one per sheet otherwise, each in chunks.

    ``sheets`` is the output of ``classify_sheets``. Rows are rendered before they are repeated in blocks, so the cells are
    grouped once and never joined back, and dealt once by their block's stretches; what is known of a block goes along.
    """
    facts = ["classification", "detected_hotel_name", "block_title", "block_count"]
    rows = _block_rows(cells, sheets).withColumnRenamed("title", "block_title").withColumn("_stretch", F.floor(F.col("line") / ROWS_PER_DEAL))
    dealt = rows.select(*BLOCK, "_stretch", "line", "_body", "_used", *facts).repartition(*BLOCK, "_stretch")
    return grid_text(dealt, BLOCK, "block_doc_id", characters, facts).withColumnRenamed("text", "raw_excerpt").select(
        *BLOCK, "chunk", "raw_excerpt", *facts)


def _crowded(*sides: tuple[DataFrame, int]) -> DataFrame:
    """Hashes of the sheets that have more rows on a side than it may have. Written, so that few of them are a small table.

    Sheets that share a hash count as one, which only makes them crowded sooner.
    """
    tagged = [df.select(F.xxhash64(*DOC).alias("_sheet"), F.lit(i).alias("_side")) for i, (df, _) in enumerate(sides)]
    counts = reduce(DataFrame.union, tagged).groupBy("_sheet").agg(
        *[F.count_if(F.col("_side") == i).alias(f"_n{i}") for i in range(len(sides))])
    more = reduce(Column.__or__, [F.col(f"_n{i}") > most for i, (_, most) in enumerate(sides)])
    return stage(counts.where(more).select("_sheet"))


def _of_sheets(df: DataFrame, crowded: DataFrame, how: str) -> DataFrame:
    return df.withColumn("_sheet", F.xxhash64(*DOC)).join(crowded, "_sheet", how).drop("_sheet")


def _by_sheet(df: DataFrame) -> DataFrame:
    """Rows dealt by their sheet, where groupings and joins by sheet find them; for sheets that are not crowded."""
    return df.repartition(*DOC).hint("merge")


def _in_sheet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on sheet and the integer ``key``, which is only tested: as a key of the join it would have both sides dealt anew."""
    theirs = right.withColumnsRenamed({c: f"_their_{c}" for c in (*DOC, key)})
    sheet = reduce(Column.__and__, [F.col(c) == F.col(f"_their_{c}") for c in DOC])
    return left.join(theirs, sheet & (F.col(key) - F.col(f"_their_{key}") == 0)).drop(*[f"_their_{c}" for c in (*DOC, key)])


def _narrowed_by_sheet(block_columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """J7 for sheets that are not crowded: each child column looks at all overrides of its sheet."""
    known = overrides.where(F.col("age_from").isNotNull() & F.col("age_to").isNotNull())
    own = known.select(*DOC, F.struct("position", "age_from", "age_to", "ord").alias("_override")).repartition(*DOC).groupBy(*DOC).agg(
        F.collect_list("_override").alias("_overrides")).hint("merge")
    age_from, age_to = F.col("age_from"), F.col("age_to")
    inside = F.filter("_overrides", lambda o: (o["position"] == F.col("position")) & (o["age_from"] >= age_from) & (o["age_to"] <= age_to)
                      & (o["age_to"] - o["age_from"] < age_to - age_from))
    best = F.array_min(F.transform(inside, lambda o: F.struct(
        (o["age_to"] - o["age_from"]).alias("width"), o["ord"].alias("ord"), o["age_from"].alias("_from"), o["age_to"].alias("_to"))))
    return _by_sheet(block_columns).join(own, DOC, "left").withColumn("_best", F.when(F.col("role") == "child", best)).withColumns({
        "age_from": F.coalesce("_best._from", "age_from"), "age_to": F.coalesce("_best._to", "age_to"),
    }).drop("_best", "_overrides")


def narrow_child_ages(block_columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """A child column takes the narrowest override of its position that lies inside its ages.

    An override with another one inside it is never the narrowest, so only the innermost spans, found by a sweep, are
    compared; no two of them share a start, which bounds them by the ages there are.
    """
    position = [*DOC, "position"]
    known = overrides.where(F.col("age_from").isNotNull() & F.col("age_to").isNotNull()).groupBy(*position, "age_from", "age_to").agg(
        F.min("ord").alias("_ord")
    )
    # With the signs of both ends turned, a span that holds another one lies inside it.
    turned = known.select(*position, (-F.col("age_from")).alias("_from"), (-F.col("age_to")).alias("_to"), "_ord")
    holding = strictly_inside(turned, position, "_from", "_to", F.floor("_from"))
    inner = turned.join(holding, [*position, "_from", "_to"], "left_anti").select(
        *position, (-F.col("_from")).alias("_from"), (-F.col("_to")).alias("_to"), "_ord"
    )
    child = F.col("role") == "child"
    ages = [*position, "age_from", "age_to"]
    bands = block_columns.where(child & F.col("age_from").isNotNull() & F.col("age_to").isNotNull()).select(*ages).distinct()
    inside = bands.join(inner, position).where(
        (F.col("_from") >= F.col("age_from")) & (F.col("_to") <= F.col("age_to"))
        & (F.col("_to") - F.col("_from") < F.col("age_to") - F.col("age_from"))
    )
    best = inside.groupBy(*ages).agg(
        F.min_by(F.struct("_from", "_to"), F.struct(F.col("_to") - F.col("_from"), F.col("_ord"))).alias("_best")
    )
    return block_columns.join(best, ages, "left").withColumns({
        "age_from": F.coalesce("_best._from", "age_from"), "age_to": F.coalesce("_best._to", "age_to"),
    }).drop("_best")


def match_rooms(rows: DataFrame, occupancy: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """J6's join: the best occupancy entry of each distinct room name of a document; the first entry on a tie.

    Names are matched once per document and name, however many rows carry them. ``names`` (document and room, at least
    those of ``rows``) spares the work of making the rows twice. Sheets with few names and entries compare them all in the
    task that the sheet is dealt to; only crowded ones are indexed.
    """
    names = (rows if names is None else names).select(*DOC, "room").where(~is_blank("room"))
    crowded = _crowded((names, FACTS_PER_SHEET), (occupancy, FACTS_PER_SHEET))
    if crowded.isEmpty():
        return _match_by_sheet(names, occupancy)
    few, many = ([_of_sheets(df, crowded, how) for df in (names, occupancy)] for how in ("left_anti", "left_semi"))
    return _match_by_sheet(*few).union(_match_by_index(*many))


ROOM_ENTRY = ("ord", "room_name", "min_adult", "max_adult", "max_pax", "max_child")


def _match_by_sheet(names: DataFrame, occupancy: DataFrame) -> DataFrame:
    listed = occupancy.select(*DOC, fold("room_name").alias("_listed"), F.struct(*ROOM_ENTRY).alias("_entry")).where(F.col("_listed") != "")
    asked = names.repartition(*DOC).distinct().hint("merge")
    scored = asked.join(_by_sheet(listed), DOC).withColumn("_score", room_match_score("room", "_listed")).where(F.col("_score") > 0)
    best = F.struct(fold("room") != F.col("_listed"), -F.col("_score"), F.col("_entry"))
    return scored.groupBy(*DOC, "room").agg(F.min_by("_entry", best).alias("_entry"))


def _match_by_index(names: DataFrame, occupancy: DataFrame) -> DataFrame:
    """``match_rooms`` for sheets of any size. Equal names are an equi join and end the search.
    Contained names come from a gram index. Shared words come from a word index: an entry met under a name's rarest word,
    or one contained, bounds the score to beat, and an entry that reaches it shares one of the name's rarest words, as
    many as the bound leaves open, so only these words are asked for. No pair is made for sharing a sheet alone.
    """
    names = names.distinct().hint("merge")
    entry = F.struct(*ROOM_ENTRY)
    listed = stage(occupancy.where(fold("room_name") != "").groupBy(*DOC, fold("room_name").alias("_listed")).agg(F.min(entry).alias("_entry"))).hint("merge")
    keyed = names.withColumn("_name", fold("room")).where(F.col("_name") != "")
    asked = stage(keyed.select(*DOC, "_name").distinct().join(
        listed.withColumn("_name", F.col("_listed")).withColumnRenamed("_entry", "_equal").drop("_listed"), [*DOC, "_name"], "left")).hint("merge")
    equal = asked.where(F.col("_equal").isNotNull()).select(*DOC, "_name", F.col("_equal").alias("_entry"))
    left = asked.where(F.col("_equal").isNull()).select(*DOC, "_name", room_tokens("_name").alias("_words"))

    ours, theirs = (df.select(*DOC, F.col(c).alias("needle"), F.col(c).alias("text")) for df, c in ((left, "_name"), (listed, "_listed")))
    contained = contained_pairs(ours, theirs, DOC).toDF(*DOC, "_name", "_listed").union(
        contained_pairs(theirs, ours, DOC).select(*DOC, "text", "needle")
    )
    index = listed.select(*DOC, "_listed", F.explode(room_tokens("_listed")).alias("word"))
    held = index.groupBy(*DOC, "word").agg(F.count(F.lit(1)).alias("_entries"))
    ranked = left.select(*DOC, "_name", "_words", F.explode("_words").alias("word")).join(held, [*DOC, "word"]).groupBy(*DOC, "_name").agg(
        F.array_sort(F.collect_list(F.struct("_entries", "word"))).alias("_ranked"), F.first("_words").alias("_words")
    ).hint("merge")
    rarest = ranked.withColumn("word", F.get("_ranked", F.lit(0))["word"]).join(index, [*DOC, "word"])
    bound = rarest.groupBy(*DOC, "_name").agg(F.max(F.size(F.array_intersect("_words", room_tokens("_listed")))).alias("_least"))
    sure = contained.select(*DOC, "_name").distinct().withColumn("_sure", F.lit(10))
    asking = ranked.join(bound, [*DOC, "_name"]).join(sure, [*DOC, "_name"], "left").select(*DOC, "_name", F.inline(F.slice(
        "_ranked", F.lit(1), F.greatest(F.size("_ranked") - F.greatest("_least", F.coalesce("_sure", F.lit(1))) + 1, F.lit(0))
    ))).drop("_entries")
    near = asking.join(index, [*DOC, "word"]).select(*DOC, "_name", "_listed").union(contained).distinct()
    scored = near.withColumn("_score", room_match_score("_name", "_listed")).where(F.col("_score") > 0).join(listed, [*DOC, "_listed"])
    found = equal.union(scored.groupBy(*DOC, "_name").agg(F.min_by("_entry", F.struct(-F.col("_score"), "_entry")).alias("_entry")))
    return keyed.join(found, [*DOC, "_name"]).select(*DOC, "room", "_entry")


def apply_occupancy(rows: DataFrame, occupancy: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """J6 and PF13: blank guest limits from the matched entry; child values cleared where it allows no children."""
    return _limited(rows.join(match_rooms(rows, occupancy, names), [*DOC, "room"], "left"))


def _limited(matched: DataFrame) -> DataFrame:
    joined = matched.withColumns({
        f: F.coalesce(F.col(f), F.col(f"_entry.{f}")) for f in ("min_adult", "max_adult", "max_pax")
    })
    return clear_child_values(joined, F.col("_entry.max_child")).drop("_entry")


def has_base_price_and_dates(rows: DataFrame) -> DataFrame:
    """PF9: grid rows without a base price or either date are skipped."""
    return rows.where(
        F.col("base").isNotNull() & F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    )


SCALAR_ROLES = ("date_from", "date_to", "base_room", "sgl_supp", "tpl_reduct", "qdp_reduct", "extra_bed", "release")
# What a block's heading and the options give to its rows.
DRESSED = (
    "meal_plan", "supplier", "country_code", "state_region", "city_area", "currency", "customer_currency", "rate_type", "status",
    "check_in", "check_out",
)
MEAL_FIELDS = {
    "SUPP-HB-ADULT": "supp_hb_adult", "SUPP-HB-CHILD": "supp_hb_child", "SUPP-AI-ADULT": "supp_ai_adult",
    "SUPP-AI-CHILD": "supp_ai_child",
}


def _keyed_columns(block_columns: DataFrame, overrides: DataFrame) -> DataFrame:
    return _keyed(narrow_child_ages(block_columns, overrides))


def _keyed(narrowed: DataFrame) -> DataFrame:
    return narrowed.withColumn(
        "key", F.when(F.col("role") == "child", child_key("position", "age_from", "age_to"))
    )


def block_child_columns(block_columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Child columns of the expanded blocks."""
    return _keyed_columns(block_columns, overrides).where(F.col("role") == "child").select(
        *DOC, "block_idx", "ord", "key", F.col("key").alias("label"), "age_from", "age_to", "position",
        F.coalesce(blank("value_type"), F.lit("unknown")).alias("value_type"),
    )


def _roles_by_stretch(cells: DataFrame, blocks: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """The roles of each block's columns, once for every stretch of ``width`` rows in which the block has cells to read.

    Stretches are those the sheet has, so an open end costs nothing; a block meets a sheet's stretches, never its cells.
    """
    stretches = cells.select(*DOC, F.floor(F.col("row_idx") / width).alias("_stretch")).distinct()
    first, last = (F.floor(F.col(c) / width) for c in ("first_data_row_idx", "last_data_row_idx"))
    there = blocks.select(*DOC, "block_idx", "first_data_row_idx", "last_data_row_idx").join(stretches, DOC).where(
        F.col("_stretch").between(first, last)
    )
    return keyed.hint("merge").join(there, [*DOC, "block_idx"])


def grid_rows(
    cells: DataFrame, blocks: DataFrame, block_columns: DataFrame, overrides: DataFrame, width: int = ROWS_PER_STRETCH,
) -> DataFrame:
    """Each data row of a block with its cells under their roles: one join and one grouping over the cells.

    Cells, roles and overrides of a sheet are dealt to one task, so the cells move once; crowded sheets are spread.
    """
    crowded = _crowded((cells, CELLS_PER_SHEET), (block_columns, FACTS_PER_SHEET), (overrides, FACTS_PER_SHEET), (blocks, FACTS_PER_SHEET))
    if crowded.isEmpty():
        return _grid_rows_by_sheet(cells, blocks, block_columns, overrides)
    sides = (cells, blocks, block_columns, overrides)
    few, many = ([_of_sheets(df, crowded, how) for df in sides] for how in ("left_anti", "left_semi"))
    return _grid_rows_by_sheet(*few).unionByName(_grid_rows_by_stretch(*many, width))


def _grid_rows_by_sheet(cells: DataFrame, blocks: DataFrame, block_columns: DataFrame, overrides: DataFrame) -> DataFrame:
    there = _by_sheet(blocks.select(*DOC, "block_idx", "first_data_row_idx", "last_data_row_idx"))
    roles = _in_sheet(_keyed(_narrowed_by_sheet(block_columns, overrides)), there, "block_idx").hint("merge")
    return _role_rows(_in_sheet(_by_sheet(cells.select(*DOC, "row_idx", "col_idx", "value_str")), roles, "col_idx"))


def _grid_rows_by_stretch(cells: DataFrame, blocks: DataFrame, block_columns: DataFrame, overrides: DataFrame, width: int) -> DataFrame:
    """``grid_rows`` for sheets of any size. Cells meet roles by sheet, stretch of rows and column, so a cell meets only the few blocks that touch its stretch, and
    the cells of a long sheet are spread over tasks. The row range decides inside the stretch; blocks may overlap.
    """
    keyed = _keyed_columns(block_columns, overrides)
    roles = _roles_by_stretch(cells, blocks, keyed, width)
    return _role_rows(cells.select(*DOC, "row_idx", "col_idx", "value_str", F.floor(F.col("row_idx") / width).alias("_stretch")).join(
        roles, [*DOC, "_stretch", "col_idx"]
    ))


def _role_rows(met: DataFrame) -> DataFrame:
    """Cells with their roles, gathered to the data rows of blocks."""
    placed = met.where(
        F.col("row_idx").between(F.col("first_data_row_idx"), F.col("last_data_row_idx"))
    ).withColumn("_num", to_float("value_str"))

    def only(role: str, value: Column) -> Column:
        return F.max(F.when(F.col("role") == role, value))

    supp = F.coalesce(blank("supp_field"), F.lit("SUPP-AI-ADULT"))
    child = F.when(F.col("role") == "child", F.struct("ord", "key", "_num"))
    upgrade = F.when((F.col("role") == "upgrade") & F.col("_num").isNotNull(), F.struct(
        "ord", F.coalesce(blank("label"), F.lit("Upgrade")).alias("label"), F.col("_num").alias("supplement")
    ))
    return placed.groupBy(*DOC, "block_idx", "row_idx").agg(
        only("date_from", normalize_iso_date("value_str")).alias("start_date"),
        only("date_to", normalize_iso_date("value_str")).alias("end_date"),
        only("base_room", F.col("_num")).alias("base"),
        *[only(r, F.col("_num")).alias(r) for r in ("sgl_supp", "tpl_reduct", "qdp_reduct", "extra_bed")],
        only("release", to_int("value_str")).alias("release_period"),
        F.array_sort(F.collect_list(child)).alias("_children"),
        F.array_sort(F.collect_list(upgrade)).alias("_upgrades"),
        *[
            F.max_by(
                F.col("_num"),
                F.when((F.col("role") == "meal_upgrade") & (supp == field) & F.col("_num").isNotNull(), F.col("ord")),
            ).alias(f"_{name}")
            for field, name in MEAL_FIELDS.items()
        ],
    )


def expand_blocks(
    cells: DataFrame, blocks: DataFrame, block_columns: DataFrame, overrides: DataFrame, occupancy: DataFrame,
    meta: DataFrame, options: DataFrame,
) -> DataFrame:
    """EX1: one row per data row and room, the base room first, then each priced upgrade.

    Child values keep every key of the block; a repeated key takes its last column. What is known of a block is put
    together before rows meet it. The tables of a sheet that is not crowded are dealt by sheet, and its rows stay there.
    """
    names = block_columns.where(F.col("role").isin("base_room", "upgrade"))
    sides = [(cells, CELLS_PER_SHEET), *[(df, FACTS_PER_SHEET) for df in (blocks, block_columns, overrides, occupancy, names, meta)]]
    crowded = _crowded(*sides)
    if crowded.isEmpty():
        return _expanded(cells, blocks, block_columns, overrides, occupancy, meta, options, True)
    few, many = ([_of_sheets(df, crowded, how) for df in (cells, blocks, block_columns, overrides, occupancy, meta)]
                 for how in ("left_anti", "left_semi"))
    return _expanded(*few, options, True).unionByName(_expanded(*many, options, False))


def _expanded(
    cells: DataFrame, blocks: DataFrame, block_columns: DataFrame, overrides: DataFrame, occupancy: DataFrame, meta: DataFrame,
    options: DataFrame, by_sheet: bool,
) -> DataFrame:
    keyed = _keyed(_narrowed_by_sheet(block_columns, overrides)) if by_sheet else _keyed_columns(block_columns, overrides)
    keys = keyed.where(F.col("role") == "child").groupBy(*DOC, "block_idx").agg(
        F.collect_set("key").alias("_keys")
    )
    base_label = block_columns.where(F.col("role") == "base_room").groupBy(*DOC, "block_idx").agg(
        F.max(blank("label")).alias("_base_label")
    )
    boards = last_row(meta, DOC).select(*DOC, meal_from_treatment("basic_treatment").alias("meal_plan"))
    defaults = last_row(options, ["contract_id"]).select(
        "contract_id", F.coalesce(blank("status"), F.lit("Open")).alias("status"), "check_in", "check_out"
    )
    known = blocks.select(
        *DOC, "block_idx", "title", F.lit(None).cast("string").alias("hotel"), F.lit(None).cast("string").alias("star_rating"),
    ).join(keys, [*DOC, "block_idx"], "left").join(base_label, [*DOC, "block_idx"], "left").hint("merge")
    dressed = apply_meta(known.join(boards, DOC, "left"), meta, options).join(defaults, "contract_id", "left")
    if by_sheet:
        priced = _in_sheet(has_base_price_and_dates(_grid_rows_by_sheet(cells, blocks, block_columns, overrides)), _by_sheet(dressed), "block_idx")
    else:
        priced = has_base_price_and_dates(_grid_rows_by_stretch(cells, blocks, block_columns, overrides, ROWS_PER_STRETCH)).join(
            dressed, [*DOC, "block_idx"])
    base_room = F.struct(
        F.lit(-1).alias("ord"), F.coalesce("_base_label", F.lit("Standard")).alias("label"),
        F.lit(0).cast("decimal(18,6)").alias("supplement"),
    )
    upgrades = F.transform("_upgrades", lambda u: F.struct(
        u["ord"].cast("int").alias("ord"), u["label"].alias("label"), u["supplement"].alias("supplement")
    ))
    last = F.aggregate(
        "_children", F.create_map().cast("map<string,decimal(18,6)>"),
        lambda m, c: F.map_concat(F.map_filter(m, lambda k, v: k != c["key"]), F.create_map(c["key"], c["_num"])),
    )
    values = F.map_from_entries(F.transform(
        F.coalesce("_keys", F.array().cast("array<string>")),
        lambda k: F.struct(k, F.try_element_at("_last", k).cast(MONEY)),
    ))
    rooms = priced.withColumns({"_last": last}).withColumn("child_values", values).withColumn(
        "_room", F.explode(F.concat(F.array(base_room), upgrades))
    )
    dbl = F.round(F.col("base") + F.col("_room.supplement"), 2).cast(MONEY)
    rows = rooms.withColumn("dbl", dbl).select(
        *DOC, "block_idx", "row_idx", F.col("_room.ord").alias("room_ord"), F.col("doc_id").alias("sheet"),
        "hotel", "star_rating", F.col("_room.label").alias("room"), "start_date", "end_date", F.lit(ALL_WEEK).alias("days"), "release_period",
        F.coalesce(blank("title"), F.lit("Contract")).alias("rate_plan"), "dbl",
        single_price("dbl", "sgl_supp").alias("sgl"), reduced_price("dbl", "tpl_reduct").alias("tpl"),
        reduced_price("dbl", "qdp_reduct").alias("qdp"), money("extra_bed").alias("extra_bed"), "child_values",
        *[money(f"_{name}").alias(name) for name in MEAL_FIELDS.values()],
        F.lit(None).cast("int").alias("min_adult"), F.lit(None).cast("int").alias("max_adult"),
        F.lit(None).cast("int").alias("max_pax"),
        F.array(F.concat(
            "contract_id", F.lit(" | "), F.regexp_replace("doc_id", "^Sheet:", ""), F.lit("!Row "),
            (F.col("row_idx") + 1).cast("string"),
        )).alias("source_refs"),
        F.when(F.col("_room.ord") < 0, 0.92).otherwise(0.8).alias("confidence"),
        F.array().cast("array<string>").alias("warnings"), F.create_map().cast(CELL_META).alias("cell_meta"),
        F.lit("auto").alias("review_state"), *DRESSED,
    )
    # Every row's room is the label of its base column or of an upgrade column, so the names need no rows.
    upgrade_names = block_columns.where(F.col("role") == "upgrade").select(*DOC, F.coalesce(blank("label"), F.lit("Upgrade")).alias("room"))
    base_names = base_label.select(*DOC, F.coalesce("_base_label", F.lit("Standard")).alias("room"))
    names = base_names.union(upgrade_names)
    if not by_sheet:
        return apply_occupancy(rows, occupancy, names)
    entries = _match_by_sheet(names.where(~is_blank("room")), occupancy).groupBy(*DOC).agg(
        F.map_from_entries(F.collect_list(F.struct("room", "_entry"))).alias("_entries")).hint("merge")
    return _limited(rows.join(entries, DOC, "left").withColumn("_entry", F.try_element_at("_entries", F.col("room"))).drop("_entries"))


def period_column_rows(table: DataFrame, periods: list[str], rooms: DataFrame) -> DataFrame:
    """EX18: a table with one column per period becomes one row per room and period, priced per room.

    Single and double are the cell; triple and quad repeat it where the room takes that many guests.
    """
    ids = [c for c in table.columns if c not in periods]
    price = F.col("price").cast(MONEY)
    return (
        table.unpivot(ids, periods, "period", "price").where(F.col("price").isNotNull())
        .join(rooms.select(*DOC, "room", "max_pax"), [*DOC, "room"], "left")
        .select(
            *ids, "period", price.alias("dbl"), price.alias("sgl"), F.when(F.col("max_pax") >= 3, price).alias("tpl"),
            F.when(F.col("max_pax") >= 4, price).alias("qdp"), F.lit("Room Only").alias("meal_plan"), "max_pax",
        )
    )


def split_stacked_periods(cells: DataFrame) -> DataFrame:
    """EX19: 'a - b & c - d' becomes two periods that share their price group."""
    keys = ["contract_id", "doc_id", "table_idx", "row_idx"]
    return cells.select(
        *keys, F.concat_ws("/", *keys).alias("price_group"),
        F.posexplode(F.split("raw", r"\s+&\s+")).alias("period_idx", "_period"),
    ).withColumn("period", F.btrim("_period")).drop("_period")
