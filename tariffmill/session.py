"""Session settings and the one place where a plan's lineage may be cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster. Shuffle partition counts are an upper bound that adaptive
# execution coalesces; joins whose side proves small at run time turn into broadcasts, and skewed partitions are split.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tariffmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings. ``master`` is for local runs; a cluster supplies its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a scratch folder only on a local master when none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="tariffmill-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run, below the checkpoint folder all machines share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


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


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files.

    Used where one table feeds several outputs: the work is done once, and a lost executor re-reads files instead of
    recomputing the branch. The files are Parquet, several times smaller than a checkpoint's plain rows; they stay until
    the owner of the checkpoint folder clears it. The shuffle files of the work go as soon as it is written.
    """
    path = shared_folder(df.sparkSession, "stage")
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
