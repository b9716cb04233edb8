"""Joining parts: chunks of one contract, per-hotel results, summaries, and the split into chunks itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, first_filled, fold
from tariffmill.operators.dedup import dedup_child_columns, dedup_notes
from tariffmill.operators.grid import is_priced
from tariffmill.operators.shaping import group_rank, keep_first

CONTEXT_CLASSES = ("index_reference", "support_notes")


def chunk_documents(documents: DataFrame, size: int = 1) -> DataFrame:
    """Contract documents in chunks of ``size``; index and notes documents go to every chunk, others to chunk 0.

    Contracts with at most ``size`` contract documents are one chunk with everything. The place of a document in its
    contract comes from a two-level count.
    """
    hotel_docs = documents.where(F.col("classification") == "hotel_contract")
    placed = group_rank(hotel_docs, ["contract_id"], "ord", "_place").withColumn(
        "chunk_idx", F.floor((F.col("_place") - 1) / size)
    ).drop("_place")
    counts = hotel_docs.groupBy("contract_id").agg(F.count(F.lit(1)).alias("_docs"))
    chunks = F.ceil(F.coalesce("_docs", F.lit(0)) / size).cast("int")
    others = documents.where(
        F.coalesce(F.col("classification") != "hotel_contract", F.lit(True))
    ).join(counts, "contract_id", "left")
    everywhere = F.col("classification").isin(*CONTEXT_CLASSES) & (chunks > 1)
    spread = F.when(F.coalesce(everywhere, F.lit(False)), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.lit(0)))
    copied = others.withColumn("_chunk", F.explode(spread)).withColumn("chunk_idx", F.col("_chunk").cast("bigint")).drop(
        "_docs", "_chunk"
    )
    return placed.unionByName(copied).select("contract_id", "chunk_idx", "doc_id", "classification", "ord")


def rate_type_vote(parts: DataFrame, rates: DataFrame) -> DataFrame:
    """AG2: the rate type with most priced rates behind it; a part counts at least once; the first part on a tie.

    ``parts`` has ``contract_id, part_idx, detected_rate_type``; ``rates`` carries ``part_idx``.
    """
    priced = rates.where(is_priced()).groupBy("contract_id", "part_idx").agg(F.count(F.lit(1)).alias("_n"))
    votes = parts.join(priced, ["contract_id", "part_idx"], "left").groupBy("contract_id", "detected_rate_type").agg(
        F.sum(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))).alias("votes"), F.min("part_idx").alias("_first")
    )
    return votes.groupBy("contract_id").agg(
        F.max_by(F.struct("detected_rate_type", "votes"), F.struct("votes", -F.col("_first"))).alias("_top")
    ).select("contract_id", "_top.*")


def aggregate_hotels(hotels: DataFrame) -> DataFrame:
    """AG3: hotels of all parts, the first of each name; nameless ones dropped; several make a contract multi-hotel.

    ``hotels`` carries ``part_idx``; ``aggregate_contract`` brings the other tables.
    """
    named = hotels.withColumn("_name", fold("hotel")).where(F.col("_name") != "")
    first = keep_first(named, ["contract_id", "_name"], F.struct("part_idx", "ord").asc())
    counts = first.groupBy("contract_id").agg((F.count(F.lit(1)) > 1).alias("is_multi_hotel"))
    return first.drop("_name").join(counts, "contract_id")


def merge_summary(summaries: DataFrame) -> DataFrame:
    """AG11a: one summary per contract: mean confidence (0.5 when unknown) and the first file and format."""
    confidence = F.round(F.avg(F.col("confidence").cast("decimal(18,6)")), 3)
    return summaries.groupBy("contract_id").agg(
        F.coalesce(confidence, F.lit(0.5)).cast("double").alias("overall_confidence"),
        F.min_by("source_file", F.when(blank("source_file").isNotNull(), F.col("part_idx"))).alias("source_file"),
        F.min_by("input_format", F.when(blank("input_format").isNotNull(), F.col("part_idx"))).alias("input_format"),
    )


def union_lists(lists: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """SO2 and AG11b: order-preserving distinct union of list entries, in long form with each entry's first place."""
    return lists.groupBy(*keys, value).agg(F.min(order).alias("first_ord"))


def merge_hotels(hotels: DataFrame, fields: list[str]) -> DataFrame:
    """AG12: one hotel per name: each field from the first part that fills it; ``hotel_lists`` unites what it holds."""
    named = hotels.withColumn("hotel", first_filled("hotel", F.lit("Unknown Hotel")))
    at = F.struct("part_idx", "ord")
    return named.groupBy("contract_id", "hotel").agg(
        *[F.min_by(f, F.when(blank(f).isNotNull(), at)).alias(f) for f in fields], F.min(at).alias("_at")
    ).select("contract_id", "hotel", *fields, F.col("_at.part_idx").alias("first_part"), F.col("_at.ord").alias("first_ord"))


def unite_parts(*parts: DataFrame) -> DataFrame:
    """One table of all parts' rows; a column that a part lacks is null in its rows."""
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def hotel_lists(lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """AG12's rate blocks, rooms and child policies: those of all parts under the name that ``merge_hotels`` gives, in long form.

    Nothing is gathered and nothing left out; ``part_idx, ord`` is the order of a hotel's entries.
    """
    return {name: df.withColumn("hotel", first_filled("hotel", F.lit("Unknown Hotel"))) for name, df in lists.items()}


def aggregate_contract(hotels: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """AG3 whole: the hotels of all parts once each, and every other table of the parts with all of its rows."""
    return {"hotels": aggregate_hotels(hotels), **tables}


def usage_totals(usage: DataFrame) -> DataFrame:
    """AG13: usage counters summed by key over a contract's chunks."""
    return usage.select("contract_id", F.explode("usage").alias("counter", "n")).where(
        F.col("n").isNotNull()
    ).groupBy("contract_id", "counter").agg(F.sum("n").alias("total"))


def failed_chunks(chunks: DataFrame) -> DataFrame:
    """AG22 in long form: each error of each failed chunk, with its place in the chunk."""
    return chunks.select("contract_id", "chunk_idx", F.posexplode("errors").alias("place", "error"))


def chunk_failure_notes(chunks: DataFrame) -> DataFrame:
    """AG22: one note per contract on its failed chunks: how many, and each failure in long form beside it.

    The text lists chunk numbers and errors; chunks per contract are bounded by its documents.
    """
    entry = F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string"), F.lit(": "), F.array_join("errors", ", "))
    failed = chunks.where(F.size("errors") > 0)
    listed = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_idx", entry.alias("text")))), lambda s: s["text"]
    ), "; ")
    return failed.groupBy("contract_id").agg(F.count(F.lit(1)).alias("failed"), listed.alias("_listed")).select(
        "contract_id", "failed", F.lit("Source ambiguity").alias("category"),
        F.concat(F.col("failed").cast("string"), F.lit(" extraction chunk(s) failed: "), "_listed").alias("note"),
    )


def merge_chunks(
    rows: DataFrame, notes: DataFrame, columns: DataFrame, issues: DataFrame, summaries: DataFrame | None = None,
    summary_lists: DataFrame | None = None, hotels: DataFrame | None = None, hotel_fields: tuple[str, ...] = (),
    lists: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """SO1: the tables of all chunks as the contract's: rows and issues as they are, notes and columns without repeats.

    Inputs are already united over chunks with a contract-wide ``ord``. With ``summaries`` and their entries
    ``summary_lists`` (contract_id, list, entry, ord) come the AG11 summary and lists, with ``hotels`` and what they hold
    (``lists``, such as rate_blocks, rooms and child_policies) the AG12 hotels and their lists.
    """
    merged = {
        "rows": rows, "issues": issues, "notes": dedup_notes(notes), "child_columns": dedup_child_columns(columns),
    }
    if summaries is not None:
        merged["summary"] = merge_summary(summaries)
    if summary_lists is not None:
        merged["summary_lists"] = union_lists(summary_lists, ["contract_id", "list"], "entry", "ord")
    if hotels is not None:
        merged["hotels"] = merge_hotels(hotels, list(hotel_fields))
    return merged | hotel_lists(lists or {})


FRAME = ("part", "contract_id", "key", "field", "value")


def long_form(part: str, df: DataFrame, key: Column, fields: list[str], at: Column | None = None, filled: bool = False) -> DataFrame:
    """A table's rows as tagged values: part, contract, key of the entity, field, value as text and the value's place ``at``.

    With ``filled`` only fields that hold something come along, so that each field is taken from the first part that
    fills it; otherwise all do, and an entity's fields all come from its first row.
    """
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    if filled:
        values = F.filter(values, lambda v: blank(v["value"]).isNotNull())
    place = _place(F.lit(0), F.col("ord")) if at is None else at
    return df.select(F.lit(part).alias("part"), "contract_id", key.cast("string").alias("key"), place.alias("at"), F.inline(values))


def _place(part: Column, order: Column) -> Column:
    return F.struct(part.cast("bigint").alias("part_idx"), order.cast("bigint").alias("ord"))


def first_values(*frames: DataFrame) -> DataFrame:
    """Any number of tagged tables merged by one grouping: of each entity and field the first value."""
    return unite_parts(*frames).groupBy(*FRAME[:-1]).agg(F.min_by("value", "at").alias("value"))


def take_apart(frame: DataFrame, part: str, fields: list[str]) -> DataFrame:
    """One table of a tagged frame as columns again."""
    own = frame.where(F.col("part") == part)
    return own.groupBy("contract_id", "key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


#: Fields that make up each table of a merged contract in its long form.
MERGED_FIELDS = {
    "rows": ["hotel", "room", "start_date", "end_date", "meal_plan"], "issues": ["hotel", "severity", "message", "field"],
    "notes": ["note_id", "category", "page", "note"], "child_columns": ["key", "label", "position", "value_type"],
    "hotels": ["city_area", "phone"], "summary": ["source_file", "input_format"],
}


def merged_contract(
    rows: DataFrame, notes: DataFrame, columns: DataFrame, issues: DataFrame, summaries: DataFrame, hotels: DataFrame,
) -> DataFrame:
    """SO1 as one long frame: what all chunks of a contract hold, with its AG11 summary and AG12 hotels.

    Rows and issues stay as they are and move nowhere. Notes and child columns by their first row, hotels and the summary
    field by field are merged in one grouping over tagged values; the mean confidence is its own.
    """
    note_key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source_file", "page", "category")], fold("note"))
    named = columns.withColumn("_key", F.coalesce(blank("key"), blank("label"))).where(F.col("_key").isNotNull())
    merged = first_values(
        long_form("notes", notes, note_key, MERGED_FIELDS["notes"]), long_form("child_columns", named, F.col("_key"), MERGED_FIELDS["child_columns"]),
        long_form("hotels", hotels, first_filled("hotel", F.lit("Unknown Hotel")), MERGED_FIELDS["hotels"], _place(F.col("part_idx"), F.col("ord")), filled=True),
        long_form("summary", summaries, F.lit(""), MERGED_FIELDS["summary"], _place(F.col("part_idx"), F.lit(0)), filled=True),
    )
    kept = [
        long_form(n, df, F.col("row_id"), MERGED_FIELDS[n], _place(F.lit(0), F.lit(0))).select(*FRAME) for n, df in (("rows", rows), ("issues", issues))
    ]
    confidence = merge_summary(summaries).select(
        F.lit("summary").alias("part"), "contract_id", F.lit("").alias("key"), F.lit("overall_confidence").alias("field"),
        F.col("overall_confidence").cast("decimal(18,3)").cast("string").alias("value"),
    )
    return unite_parts(merged.select(*FRAME), *kept, confidence)


def missing_supplement_names(findings: DataFrame) -> DataFrame:
    """SO3: names the audit found missing, once per spelling-insensitive name, in the first spelling."""
    named = findings.where(F.col("finding_kind") == "MISSING_SUPPLEMENT").withColumn(
        "name", F.btrim("missing_supplement_name")
    ).where(F.col("name") != "")
    return keep_first(named.withColumn("_name", F.lower("name")), ["contract_id", "hotel", "_name"]).select(
        "contract_id", "hotel", "name", "ord"
    )


UNSTABLE = ("row_id", "source_refs", "confidence", "warnings", "cell_meta", "review_state", "ord")
SIGNATURE = ("hotel", "room", "start_date", "end_date", "meal_plan")


def _surplus(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference of the rows of both sides by ``keys``, contract by contract.

    A contract's rows add up to a fingerprint: two sums of 64-bit hashes and a count, one side's taken from the other's.
    Where all three are zero both sides hold the same rows, so only the rows of other contracts are exchanged for the
    difference in detail, where both sides are counted with opposite signs.
    """
    both = actual.select(*keys, F.lit(1).alias("_sign")).unionByName(expected.select(*keys, F.lit(-1).alias("_sign")))

    def differs(value: Column) -> Column:
        return F.sum(value.cast("decimal(20,0)") * F.col("_sign")) != 0

    prints = both.groupBy("contract_id").agg(
        differs(F.lit(1)).alias("_count"), differs(F.xxhash64(*keys)).alias("_one"), differs(F.xxhash64(F.lit(17), *keys[::-1])).alias("_two"),
    ).where(F.col("_count") | F.col("_one") | F.col("_two")).select("contract_id").alias("d")
    differing = both.alias("b").join(prints, F.col("b.contract_id").eqNullSafe(F.col("d.contract_id")), "left_semi")
    return differing.groupBy(*keys).agg(F.sum("_sign").alias("surplus")).where(F.col("surplus") != 0)


def golden_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SO7: rows one result has and the other lacks, as a multiset, ignoring ids, references, confidence and marks."""
    stable = [c for c in actual.columns if c not in UNSTABLE]

    def flat(df: DataFrame) -> DataFrame:
        return df.select(*[
            F.to_json(F.array_sort(F.map_entries(c))).alias(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in stable
        ])

    return _surplus(flat(actual), flat(expected), stable)


def issue_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SO7's issue part: multiset difference of (severity, field, hotel)."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("severity", "field", "hotel")]
    return _surplus(actual.select("contract_id", *keys), expected.select("contract_id", *keys), ["contract_id", "severity", "field", "hotel"])
