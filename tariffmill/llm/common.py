"""What the text operators share: intermediate tables in the shared folder, row keys and words."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffmill.session import checkpoint_dir

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()`` uses the same six.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"


#: Spark removes an execution's shuffle files when it ends, instead of when the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the folder all machines share.

    A written table cuts the lineage: a lost executor re-reads files. ``drop`` removes tables no later step reads; those
    that the returned frame reads stay until the owner of the checkpoint folder clears it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, {CLEAN_SHUFFLES: "true"}):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))
        self.release()

    def release(self) -> None:
        """Let Spark's context cleaner remove the shuffle files of finished steps now, not at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_hash(column: str = "text") -> Column:
    """With the id, names a row: rows that agree in both hold the same text and get the same result."""
    return F.xxhash64(text_or_empty(column))


def same_row(left: DataFrame, right: DataFrame, id_column: str = "doc_id") -> Column:
    return left[id_column].eqNullSafe(right[id_column]) & (left["text_hash"] == right["text_hash"])


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def words(column: Column) -> Column:
    """The words of a text in order; no words: an empty array."""
    inner = trimmed(column)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def free_name(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        fresh = name
        while fresh.lower() in taken:
            fresh = f"_{fresh}"
        taken.add(fresh.lower())
        out[name] = fresh
    return out
