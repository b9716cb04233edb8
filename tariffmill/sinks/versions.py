"""Keyed tables in versions: a save appends one, and a commit file written last publishes it.

``data/`` holds one folder a save, ``commits/`` one small file a version that names its folder. Readers look only at what
commits name, so a save that fails half way leaves the table as it was, and its number goes to the next save. Creating
the commit file is the one step that decides between two writers; the loser's folder is never named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"


@dataclass(frozen=True)
class Commit:
    version: int
    folder: str
    #: A whole table; older versions are not needed to read it.
    whole: bool
    #: Names the work that was saved, such as a micro-batch; the same work is saved once.
    token: str


class VersionedTable:
    """Rows by ``keys``: a version replaces all rows of each key it has and leaves other keys as they were."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _open(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def commits(self, until: int | None = None) -> list[Commit]:
        """What a reader of version ``until`` (the latest by default) needs: commits from its last whole table on."""
        fs, folder = self._open(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder) if f.getLen() > 0), reverse=True)
        found: list[Commit] = []
        for name in names:
            if not name.isdigit() or (until is not None and int(name) > until):
                continue
            stream = fs.open(self._open(f"{self.path}/commits/{name}")[1])
            try:
                found.append(Commit(**json.loads(bytes(stream.readAllBytes()).decode())))
            finally:
                stream.close()
            if found[-1].whole:
                break
        return found[::-1]

    def saved(self, token: str) -> bool:
        return any(commit.token == token for commit in self.commits())

    def save(self, rows: DataFrame, token: str = "", whole: bool = False) -> int:
        """Append ``rows`` as the next version and return its number; work that bears the token of a commit is not saved again."""
        known = self.commits()
        for commit in known:
            if token and not whole and commit.token == token:
                return commit.version
        version = known[-1].version + 1 if known else 0
        folder = f"{version:010d}-{uuid.uuid4().hex}"
        rows.withColumn(VERSION, F.lit(version)).write.mode("errorifexists").parquet(f"{self.path}/data/{folder}")
        fs, target = self._open(f"{self.path}/commits/{version:010d}")
        # Written beside first and renamed, so that no reader sees half a commit; a rename onto an existing file fails.
        draft = self._open(f"{self.path}/commits/.{folder}")[1]
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(asdict(Commit(version, folder, whole, token))).encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.path} was saved by another writer")
        return version

    def load(self, version: int | None = None) -> DataFrame:
        """The table as of ``version``, the latest by default: of each key the rows of its newest version."""
        commits = self.commits(version)
        if not commits or (version is not None and commits[-1].version < version):
            raise LookupError(f"{self.path} has no version {'at all' if version is None else version}")
        rows = self.spark.read.option("mergeSchema", len(commits) > 1).parquet(*[f"{self.path}/data/{c.folder}" for c in commits])
        if len(commits) == 1:
            return rows.drop(VERSION)
        newest = rows.groupBy(*self.keys).agg(F.max(VERSION).alias(VERSION)).alias("n")
        same = F.col(f"r.{VERSION}") == F.col(f"n.{VERSION}")
        for key in self.keys:
            same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"n.{key}"))
        return rows.alias("r").join(newest, same, "left_semi").drop(VERSION)

    def compact(self) -> int:
        """Save the latest version as a whole table, so that readers need no older folder. It keeps the token of the last save."""
        return self.save(self.load(), token=self.commits()[-1].token, whole=True)
