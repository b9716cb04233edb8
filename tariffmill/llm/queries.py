"""The operators of this package as queries over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.llm import (
    conversations, embedding_links, exact_dedup, licences, minhash, packing, periodicity, quality, sharding, substring, toxicity, warc,
)
from tariffmill.llm.bpe import Tokenizer


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, folder, "labels")))


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_read(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive(_read(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, folder, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(_read(spark, folder, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.dedup(_read(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.repeats(_read(spark, folder, "documents"), min_words=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    tokenizer = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = tokenizer.decode(tokenizer.encode(_read(spark, folder, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.assess(_read(spark, folder, "documents"))
    return found.select("doc_id", *quality.RESULTS)


def op11_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links.near_vectors(_read(spark, folder, "embeddings"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    told = _read(spark, folder, "conversations")
    return conversations.Repair(conversations.damaged(told)).summary(told)


def op13_periodicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return periodicity.summary(periodicity.periodic_runs(docs, key_column="doc_id", prepare=periodicity.planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_licences, op3_warc, op4_minhash, op5_packing, op6_sharding, op7_exact_dedup, op8_substring, op9_bpe, op10_quality,
        op11_vectors, op12_conversations, op13_periodicity,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licences": licences.ORACLE, "op3_warc": warc.ORACLE, "op4_minhash": minhash.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE,
        "op8_substring": substring.ORACLE, "op10_quality": quality.ORACLE, "op11_vectors": embedding_links.ORACLE,
    }
