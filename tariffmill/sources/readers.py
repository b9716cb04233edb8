"""Everything that turns stored bytes or text into contract tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffmill.functions.base import blank
from tariffmill.functions.names import file_kind
from tariffmill.schemas import AGE, CANONICAL_CONTRACT, MONEY

CELLS = "contract_id string, doc_id string, row_idx int, col_idx int, value_str string, value_num double, value_type string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes, found recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def landing_inventory(files: DataFrame) -> DataFrame:
    """SRC1: each file with its kind. Only the first bytes of ``content`` are looked at."""
    return files.withColumn("kind", file_kind("path", "content"))


def file_checksum(files: DataFrame) -> DataFrame:
    """SRC2: SHA-256 over each file's bytes; the bytes themselves go no further."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def duplicate_files(landing: DataFrame) -> DataFrame:
    """SRC2's report: checksums that occur more than once."""
    return landing.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def read_canonical(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """SRC3: contract JSON files under ``path``, one contract a file, or one a line with ``lines``, as the star tables.

    A contract is named by its file's path below ``path``, without the last suffix; in line files a digest of the line is
    added. ``broken`` holds name and text of what is no valid JSON, for repair; it is in no other table.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines).where(
        F.btrim("value") != ""
    ).select("value", F.col("_metadata.file_path").alias("_file"))
    folder = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    below = F.regexp_extract("_file", rf"^.*?/{folder}/(.*?)(\.[^./]*)?$", 1)
    name = F.coalesce(blank(below), F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1))
    if lines:
        name = F.concat(name, F.lit("#"), F.hex(F.xxhash64("value")))
    fields = T.StructType.fromDDL(CANONICAL_CONTRACT).fields
    schema = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = files.select(name.alias("contract_id"), "value", F.from_json("value", schema).alias("c"))
    bad = F.col("c").isNull() | F.col("c._corrupt_record").isNotNull()
    good = parsed.where(~bad).select("contract_id", *[F.col(f"c.{f}").alias(f) for f in [x.name for x in fields]])
    return {**canonical_tables(good), "broken": parsed.where(bad).select("contract_id", F.col("value").alias("text"))}


def canonical_tables(contracts: DataFrame) -> dict[str, DataFrame]:
    """SRC3 on parsed contracts: one table per entity, keyed by contract and hotel, with source ordinals."""
    hotels = contracts.select("contract_id", F.posexplode("hotels").alias("hotel_ord", "h"))

    def entity(field: str, renames: dict[str, str], money: tuple[str, ...] = (), ages: tuple[str, ...] = ()) -> DataFrame:
        rows = hotels.select(
            "contract_id", F.col("h.metadata.name").alias("hotel"), F.posexplode(f"h.{field}").alias("ord", "e")
        )
        struct = next(f.dataType for f in hotels.schema["h"].dataType.fields if f.name == field).elementType
        columns = []
        for f in struct.names:
            value = F.col(f"e.{f}")
            value = value.try_cast(MONEY) if f in money else value.try_cast(AGE) if f in ages else value
            columns.append(value.alias(renames.get(f, f)))
        return rows.select("contract_id", "hotel", *columns, "ord")

    prices = ("sgl", "dbl", "tpl", "qdp", "extra_bed_adult", "extra_bed_child")
    supplement_struct = contracts.schema["supplements"].dataType.elementType
    supplements = contracts.select("contract_id", F.posexplode("supplements").alias("ord", "e")).select(
        "contract_id",
        *[
            (
                F.col(f"e.{f}").try_cast(MONEY) if f in ("supplier_cost", "customer_price")
                else F.col(f"e.{f}").try_cast(AGE) if f in ("age_min", "age_max") else F.col(f"e.{f}")
            ).alias("hotel" if f == "hotel_name" else f)
            for f in supplement_struct.names
        ],
        "ord",
    )
    return {
        "contracts": contracts.select("contract_id", "source_filename", "is_multi_hotel", "detected_rate_type"),
        "hotels": hotels.select(
            "contract_id", F.col("h.metadata.name").alias("hotel"), "h.metadata.*", F.col("hotel_ord").alias("ord")
        ).drop("name"),
        "rooms": entity("rooms", {"name": "room"}),
        "seasons": entity("seasons", {}),
        "meals": entity("meal_plans", {}),
        "rates": entity(
            "rates", {"room_name": "room", "season_label": "season", "meal_code": "meal"}, money=prices
        ),
        "child_bands": entity("child_policy", {}, money=("value",), ages=("age_from", "age_to")),
        "supplements": supplements,
        "notes": contracts.select("contract_id", F.posexplode("notes").alias("ord", "e")).select(
            "contract_id", "e.category", "e.note", F.col("e.hotel_name").alias("hotel"), "ord"
        ),
    }


def strip_fence(text: Column | str) -> Column:
    """Model text without its surrounding code fence."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")
    opened = F.regexp_replace(t, r"^```[a-zA-Z]*\s*", "")
    return F.when(t.startswith("```"), F.btrim(F.regexp_replace(opened, r"```$", ""))).otherwise(t)


def read_raw_json(raw: DataFrame, schema: T.StructType, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """SRC4: model text as structs, and apart from them the texts that are no valid JSON, for repair."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.withColumn("_json", strip_fence(text)).withColumn("_parsed", F.from_json(
        "_json", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    ))
    keys = [c for c in raw.columns if c != text]
    bad = F.col("_parsed._corrupt_record").isNotNull() | F.col("_parsed").isNull()
    good = parsed.where(~bad).select(*keys, *[F.col(f"_parsed.{f}").alias(f) for f in schema.names])
    return good, parsed.where(bad).select(*keys, F.col(text), F.lit("invalid JSON").alias("error"))


VISION_TABLE = "array<struct<title:string,columns:array<string>,rows:array<map<string,string>>>>"


def vision_sections(raw: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """SRC5: page text before the tables header, and the fenced tables after it. Broken fences are skipped."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_tables = body.rlike(r"(?i)##\s*TABLES")
    before = F.regexp_extract(body, r"(?is)^(.*?)##\s*TABLES", 1)
    after = F.regexp_extract(body, r"(?is)^.*?##\s*TABLES(.*)$", 1)
    own_text = F.when(before.rlike(r"(?i)##\s*TEXT"), F.regexp_extract(before, r"(?is)##\s*TEXT(.*)$", 1)).otherwise(before)
    plain = F.regexp_replace(F.when(has_tables, own_text).otherwise(body), r"^\s+|\s+$", "")
    fences = F.regexp_extract_all(after, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1))
    blocks = F.when(F.size(fences) > 0, fences).otherwise(F.array(F.btrim(after)))
    keys = [c for c in raw.columns if c != text]
    texts = raw.select(*keys, plain.alias("text"))

    def tables_of(block: Column) -> Column:
        listed = F.when(F.btrim(block).startswith("["), block).otherwise(F.concat(F.lit("["), block, F.lit("]")))
        return F.from_json(listed, VISION_TABLE)

    tables = raw.where(has_tables).select(
        *keys, F.posexplode(F.filter(
            F.flatten(F.filter(F.transform(blocks, tables_of), lambda t: t.isNotNull())),
            lambda t: t["rows"].isNotNull(),
        )).alias("table_idx", "t"),
    ).select(*keys, "table_idx", "t.title", "t.columns", "t.rows", F.lit("vision").alias("source"))
    return texts, tables


def explode_dict_tables(tables: DataFrame) -> DataFrame:
    """SRC6 for tables whose rows are maps: one row per cell under its key."""
    keys = [c for c in tables.columns if c not in ("rows", "columns", "title")]
    return tables.select(*keys, F.posexplode("rows").alias("row_idx", "_r")).select(
        *keys, "row_idx", F.explode("_r").alias("col_name", "raw")
    )


def explode_list_tables(tables: DataFrame) -> DataFrame:
    """SRC6 for tables whose rows are lists: columns without a name are called col1, col2 and so on."""
    keys = [c for c in tables.columns if c not in ("rows", "columns", "title")]
    name = F.coalesce(
        F.get("columns", F.col("col_idx")), F.concat(F.lit("col"), (F.col("col_idx") + 1).cast("string"))
    )
    return tables.select(*keys, "columns", F.posexplode("rows").alias("row_idx", "_r")).select(
        *keys, "columns", "row_idx", F.posexplode("_r").alias("col_idx", "raw")
    ).select(*keys, "row_idx", name.alias("col_name"), "raw")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: cells in long form as the workbook readers leave them."""
    return spark.read.schema(CELLS).parquet(path)
