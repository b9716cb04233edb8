"""SS1 and SS2: new files once per content, and the current status of each job.

Both keep their keys for ever: the state lives in RocksDB on the executors' disks, with its changes in the checkpoint
folder, and no watermark lets a key go. Sinks may be given a micro-batch twice: landed files lie in a folder a batch, and
job states in a versioned table that saves a batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.session import settings
from tariffmill.sinks.versions import VersionedTable
from tariffmill.sources.readers import file_checksum, landing_inventory

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside in advance
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files as they arrive, with kind and checksum; their bytes go no further than the scan."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return file_checksum(landing_inventory(files))


def incremental_landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """SS1: files as they arrive, each content once for all time, in append mode; of copies in one batch any one."""
    return arriving_files(spark, path, files_per_batch).dropDuplicates(["sha256"])


def first_arrivals(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key for all time: of its first micro-batch the least by ``order``. For update mode.

    A key's state is its first row with the time of its batch, which a repeated batch keeps. Later rows leave the state as
    it is, and the row goes out in the batch of that time only. On a batch table: the first row of each key.
    """
    rest = [c for c in rows.columns if c not in (key, *order)]
    timed = rows.withColumn("_batch_at", F.current_timestamp())
    first = timed.groupBy(key).agg(F.min(F.struct("_batch_at", *order, *rest)).alias("_first"))
    return first.where(F.col("_first._batch_at") == F.current_timestamp()).select(key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def run_available(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> None:
    """Run ``stream`` over all that is there by now, in update mode; ``take`` must bear to be given a batch twice."""
    with settings(stream.sparkSession, STATE_SETTINGS):
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(take).trigger(
            availableNow=True).start().awaitTermination()


def land(files: DataFrame, sink: str, checkpoint: str, order: list[str]) -> None:
    """SS1's idempotent sink: the new contents of each micro-batch in a folder of its own, overwritten if the batch comes again."""
    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{sink}/batch={number}")

    run_available(first_arrivals(files, "sha256", order), checkpoint, take)


def landed(spark: SparkSession, sink: str) -> DataFrame:
    """All files that were landed, with the number of their micro-batch."""
    return spark.read.parquet(sink)


def job_status(events: DataFrame) -> DataFrame:
    """SS2: per job the latest event, its time and the number of events. Works on a batch and on a stream (update mode).
    """
    return events.groupBy("job_id").agg(
        F.max_by("event", F.struct("at", "event")).alias("status"), F.max("at").alias("at"),
        F.count(F.lit(1)).alias("events"),
    )


def job_event_counts(events: DataFrame) -> DataFrame:
    """SS2: events per job and kind."""
    return events.groupBy("job_id", "event").agg(F.count(F.lit(1)).alias("events"))


def merge_status(parts: DataFrame, *more: Column) -> DataFrame:
    """Job states of disjoint sets of events as one state a job; the order of the parts does not matter."""
    return parts.groupBy("job_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"), F.sum("events").alias("events"), *more,
    )


def status_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["job_id"])


def follow_jobs(events: DataFrame, path: str, checkpoint: str, compact_every: int = 100) -> None:
    """SS2 as a stream: job states after every event so far, late and repeated events included.

    An event counts when its ``event_id`` comes first. Each micro-batch saves the new state of the jobs it touches as a
    version of ``status_table`` named after it, so a repeated batch is saved once and a reader never sees half of one.
    """
    def take(batch: DataFrame, number: int) -> None:
        table = status_table(batch.sparkSession, path)
        if table.saved(f"batch-{number}"):
            batch.write.format("noop").mode("overwrite").save()  # only the stream's own state is still to be written
            return
        changed = job_status(batch)
        known = table.commits()
        if known:
            # Jobs that the batch does not touch are dropped again after the merge; no second pass over the batch finds them.
            before = table.load(known[-1].version).withColumn("_fresh", F.lit(False))
            both = changed.withColumn("_fresh", F.lit(True)).unionByName(before)
            changed = merge_status(both, F.max("_fresh").alias("_fresh")).where("_fresh").drop("_fresh")
        version = table.save(changed, token=f"batch-{number}")
        if version % compact_every == compact_every - 1 and not table.commits()[-1].whole:
            table.compact()

    run_available(first_arrivals(events, "event_id", ["at"]), checkpoint, take)
