"""Which sheet belongs to which hotel, and which documents a row's source reference points at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.functions.base import blank, fold
from tariffmill.functions.names import alnum_key
from tariffmill.operators.containment import contained_pairs, numbers_in_ranges
from tariffmill.operators.shaping import CHUNK_CHARACTERS, keep_first, prefix_sum, text_chunks

# What the original shows of a contract for a reference that leads nowhere; used only where a caller passes it.
SHOWN_CHARACTERS = 8000


def match_sheets(hotels: DataFrame, sheets: DataFrame) -> DataFrame:
    """The sheet of each hotel: by hint, by name, else by letters and digits contained either way; else null.

    The first two tiers are equi joins; only hotels they leave open are compared with their contract's sheets.
    """
    listed = sheets.select("contract_id", F.col("name").alias("sheet"), F.col("ord").alias("_sheet_ord"))
    hint = F.when(blank("source_hint").isNotNull(), fold(F.regexp_replace("source_hint", "^[^:]*:", "")))
    keyed = hotels.withColumns({"_hint": hint, "_name": fold("hotel")})
    first = listed.groupBy("contract_id", fold("sheet").alias("_key")).agg(
        F.min_by("sheet", "_sheet_ord").alias("sheet")
    )
    by_hint = first.select("contract_id", F.col("_key").alias("_hint"), F.col("sheet").alias("_by_hint"))
    by_name = first.select("contract_id", F.col("_key").alias("_name"), F.col("sheet").alias("_by_name"))
    tiered = keyed.join(by_hint, ["contract_id", "_hint"], "left").join(by_name, ["contract_id", "_name"], "left")
    exact = tiered.withColumn("_exact", F.coalesce("_by_hint", "_by_name"))
    open_hotels = exact.where(F.col("_exact").isNull()).select("contract_id", "ord", alnum_key("hotel").alias("_letters")).where(
        F.col("_letters") != ""
    )
    first_of = listed.groupBy("contract_id", alnum_key("sheet").alias("_sheet_letters")).agg(
        F.min(F.struct("_sheet_ord", "sheet")).alias("_first")
    )
    asked = open_hotels.select("contract_id", F.col("_letters").alias("needle"), F.col("_letters").alias("text")).distinct()
    there = first_of.select("contract_id", F.col("_sheet_letters").alias("needle"), F.col("_sheet_letters").alias("text"))
    pairs = contained_pairs(asked, there, ["contract_id"]).toDF("contract_id", "_letters", "_sheet_letters").union(
        contained_pairs(there, asked, ["contract_id"]).select("contract_id", "text", "needle")
    ).join(first_of, ["contract_id", "_sheet_letters"])
    # A sheet without letters or digits is contained in every name.
    nameless = first_of.where(F.col("_sheet_letters") == "").select("contract_id", F.col("_first").alias("_nameless"))
    best = pairs.groupBy("contract_id", "_letters").agg(F.min("_first").alias("_best"))
    fuzzy = open_hotels.join(best, ["contract_id", "_letters"], "left").join(nameless, "contract_id", "left").select(
        "contract_id", F.col("ord").alias("_o"), F.least("_best", "_nameless")["sheet"].alias("_fuzzy")
    )
    return exact.join(fuzzy.withColumnRenamed("_o", "ord"), ["contract_id", "ord"], "left").select(
        "contract_id", "hotel", "ord", F.coalesce("_exact", "_fuzzy").alias("sheet"),
        F.when(F.col("_by_hint").isNotNull(), "hint").when(F.col("_by_name").isNotNull(), "name")
        .when(F.col("_fuzzy").isNotNull(), "letters").alias("matched_by"),
    )


def reference_links(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each distinct source reference: the document itself, its sheet, its pages, its page range. A
    reference that leads nowhere has one row without a document, tier ``approximate``: it stands for all of its contract.

    Distinct references are resolved, not rows, and every tier is an equi join; ranges meet pages by dyadic bins. The
    result is as long as the references and their own documents, however many documents their contracts have.
    """
    asked = refs.select("contract_id", "source_ref").distinct()
    docs = documents.select("contract_id", "doc_id", "ord", "kind", "page_number", F.col("source_ref").alias("_ref"))
    names = docs.select("contract_id", "doc_id", "ord", F.explode(F.array("_ref", "doc_id")).alias("source_ref")).where(
        F.col("source_ref").isNotNull()
    )
    exact = keep_first(
        asked.join(names, ["contract_id", "source_ref"]), ["contract_id", "source_ref"]
    ).select("contract_id", "source_ref", "doc_id", F.lit("exact").alias("tier"))
    left = asked.join(exact, ["contract_id", "source_ref"], "left_anti")
    # "file | Sheet!range" names a sheet; digits in it are rows and never pages.
    sheet = F.btrim(F.regexp_extract("source_ref", r"^[^|]*\|\s*'?(.*?)'?![^!]*$", 1))
    by_sheet = left.where(F.col("source_ref").contains("!")).withColumn("doc_id", F.concat(F.lit("Sheet:"), sheet)).join(
        docs.select("contract_id", "doc_id").distinct(), ["contract_id", "doc_id"], "left_semi"
    ).select("contract_id", "source_ref", "doc_id", F.lit("sheet").alias("tier"))
    tail = F.regexp_extract("source_ref", r"^[^|]*\|([\s\S]*)$", 1)
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
    paged = left.where(F.col("source_ref").contains("|") & ~F.col("source_ref").contains("!")).withColumn("_pages", F.array_compact(F.array_distinct(numbers)))
    pages = docs.where(F.col("kind") == "pdf_page").select("contract_id", "page_number", "doc_id")
    by_page = paged.select("contract_id", "source_ref", F.explode("_pages").alias("page_number")).join(
        pages, ["contract_id", "page_number"]
    ).select("contract_id", "source_ref", "doc_id", F.lit("pages").alias("tier")).distinct()
    unpaged = paged.where(F.size("_pages") > 0).join(
        by_page.select("contract_id", "source_ref").distinct(), ["contract_id", "source_ref"], "left_anti"
    ).select("contract_id", "source_ref", F.array_min("_pages").alias("_low"), F.array_max("_pages").alias("_high"))
    by_range = numbers_in_ranges(unpaged, pages, ["contract_id"], "_low", "_high", "page_number").select(
        "contract_id", "source_ref", "doc_id", F.lit("range").alias("tier"))
    found = exact.unionByName(by_sheet).unionByName(by_page).unionByName(by_range)
    lost = asked.join(found.select("contract_id", "source_ref").distinct(), ["contract_id", "source_ref"], "left_anti")
    return found.unionByName(lost.withColumns({"doc_id": F.lit(None).cast("string"), "tier": F.lit("approximate")}))


def lost_documents(links: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of every contract that has an ``approximate`` link, once each: what these links stand for."""
    wanted = links.where("tier = 'approximate'").select("contract_id").distinct()
    return documents.join(wanted, "contract_id", "left_semi").select("contract_id", "doc_id")


def resolve_references(refs: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """J18 written out: ``reference_links`` with all documents of the contract for each reference that leads nowhere, or those
    that begin in its first ``limit`` characters. The links say the same in fewer rows.
    """
    links = reference_links(refs, documents)
    opening = opening_documents(documents, limit).select("contract_id", "doc_id")
    lost = links.where("tier = 'approximate'").drop("doc_id").join(opening, "contract_id")
    return links.where("tier <> 'approximate'").unionByName(lost)


def opening_documents(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents with their text as a ``_block``: all, or those that begin in the first ``limit`` characters of their contract.

    Lengths are added up in two levels, so a contract of very many documents is never sorted whole.
    """
    block = F.concat(F.lit("["), "doc_id", F.lit("]\n"), F.coalesce("raw_excerpt", F.lit("")))
    if limit is None:
        return documents.withColumn("_block", block)
    sized = documents.withColumn("_block", block).withColumn("_size", F.length("_block") + 2)
    summed = prefix_sum(sized, ["contract_id"], "ord", F.col("_size"), "_end")
    return summed.where(F.col("_end") - F.col("_size") < limit).drop("_size", "_end")


def opening_text(documents: DataFrame, limit: int | None = None, characters: int = CHUNK_CHARACTERS) -> DataFrame:
    """The contract's text over its documents, whole or its first ``limit`` characters, in chunks: contract, chunk, text."""
    lines = opening_documents(documents, limit).select("contract_id", "ord", F.concat("_block", F.lit("\n\n")).alias("text"))
    if limit is not None:
        ended = prefix_sum(lines, ["contract_id"], "ord", F.length("text"), "_end")
        left = F.lit(limit) - (F.col("_end") - F.length("text"))
        lines = ended.withColumn("text", F.substring("text", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).drop("_end")
    return text_chunks(lines, ["contract_id"], "ord", characters)
