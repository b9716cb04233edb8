"""Exact de-duplication as a stateful stream, in DataFrame functions only.

A compact log (digest, length, id, locator) is written for the documents and read as a stream. The stream's keyed state,
one entry a digest in RocksDB on the executors' disks with its changes in the checkpoint, holds the digest, the stable
identifier of the row that stays, that row's locator and a count, and never expires: without a watermark Spark keeps
every key. Digests seen twice are hits, and for these the full texts are compared with the text of the row that stays;
rows that differ from it in spite of an equal digest form groups by their text.

The row with the largest id stays; between rows of equal id the one with the largest locator, so exactly one row of a
group stays even when rows repeat. A null text is an empty one; null ids are smaller than all others. Other columns are
not read by ``dedup`` and pass through ``filter_documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.llm.common import CLEAN_SHUFFLES, Workspace, settings, text_or_empty

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside in advance
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    CLEAN_SHUFFLES: "true",
}
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def sha256(column: Column) -> Column:
    return F.unhex(F.sha2(column.cast("binary"), 256))


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files one to one: a scan under filters and selections only."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame, work: Workspace) -> DataFrame:
    """The rows as ``content`` (all their columns, whatever they are called), doc_id, text and ``__row_at``: file and row number.

    Rows that are not those of files one to one, as after a join or an unnesting, are written first.
    """
    try:
        scanned = docs if _is_scan(docs) else work.save(docs, "content")
        at = scanned.metadataColumn("_metadata")
        return scanned.select(F.struct("*").alias("content"), "doc_id", "text", F.struct(
            at["file_path"].alias("file"), at["row_index"].alias("row")).alias("__row_at"))
    except AnalysisException:  # files whose format numbers no rows
        return located(work.save(docs, "content"), work)


def _entry() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.col("__row_at").alias("at"))


def stream_state(log: DataFrame, work: Workspace, files_per_batch: int | None = None) -> DataFrame:
    """The state after all of ``log`` (a written table) has streamed by: one row a digest.

    Every micro-batch writes the entries it changed to its own folder, overwritten when the batch is repeated; since the
    kept entry and the count only ever grow, the largest of a digest's entries are its last ones.
    """
    spark = log.sparkSession
    with settings(spark, STATE_SETTINGS):
        reader = spark.readStream.schema(log.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        changes = reader.parquet(work.path("log")).groupBy("digest", "n_bytes").agg(
            F.max(_entry()).alias("keeper"), F.count(F.lit(1)).alias("n_rows")
        )
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", work.path("stream"))
        query = writer.foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(work.path(f"state/batch={number}"))
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    written = spark.read.schema(changes.schema).parquet(work.path("state/batch=*")) if query.lastProgress else spark.createDataFrame([], changes.schema)
    return written.groupBy("digest", "n_bytes").agg(F.max("keeper").alias("keeper"), F.max("n_rows").alias("n_rows"))


def dedup(docs: DataFrame, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: locator, doc_id, keep_id, group_size, kept and the text's SHA-256. ``digest`` may be weaker in tests.

    Rows without a twin never move with their text: they are settled by the compact log. Hits are few columns and a
    text; a digest shared by a third of all rows is joined to its one kept row, a join that adaptive execution splits.
    """
    work = Workspace(docs.sparkSession, "exact")
    rows = located(docs.select("doc_id", "text"), work)
    text = text_or_empty()
    log = work.save(rows.select(
        digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"), sha256(text).alias("sha"), "doc_id", "__row_at"
    ), "log")
    state = work.save(stream_state(log, work, files_per_batch), "entries")
    work.release()

    twins = state.where("n_rows > 1").select("digest", "n_bytes", "keeper")
    hits = work.save(rows.select(
        digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"), text.alias("text"), "doc_id", "__row_at"
    ).join(twins, ["digest", "n_bytes"]), "hits")
    work.release()
    stays = hits.where(F.col("__row_at") == F.col("keeper.at")).select("digest", "n_bytes", F.col("text").alias("kept_text"))
    checked = hits.join(stays, ["digest", "n_bytes"]).select("*", (F.col("text") == F.col("kept_text")).alias("equal"))
    odd = work.save(checked.where("NOT equal").select("digest", "n_bytes", "text", "doc_id", "__row_at"), "odd")
    odd_groups = odd.groupBy("digest", "n_bytes", "text").agg(F.max(_entry()).alias("own_keeper"), F.count(F.lit(1)).alias("own_rows"))
    odd_rows = odd.join(odd_groups, ["digest", "n_bytes", "text"]).select("digest", "__row_at", "own_keeper", "own_rows")
    odd_count = odd.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n_odd"))
    settled = log.join(state, ["digest", "n_bytes"]).join(odd_count, ["digest", "n_bytes"], "left").join(
        odd_rows.withColumnsRenamed({"digest": "odd_digest", "__row_at": "odd_at"}),
        (F.col("digest") == F.col("odd_digest")) & (F.col("__row_at") == F.col("odd_at")), "left",
    )
    keeper = F.coalesce("own_keeper", "keeper")
    return settled.select(
        "__row_at", "doc_id", keeper["id"].alias("keep_id"),
        F.coalesce("own_rows", F.col("n_rows") - F.coalesce("n_odd", F.lit(0))).alias("group_size"),
        (keeper["at"] == F.col("__row_at")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, in the columns of ``docs``."""
    work = Workspace(docs.sparkSession, "exact-rows")
    rows = located(docs, work)
    gone = work.save(dedup(rows).where("NOT kept").select("__row_at"), "gone")
    return rows.join(gone, "__row_at", "left_anti").select("content.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
    count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
