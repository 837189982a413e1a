"""Checkpoints: Parquet snapshots of named DataFrames in dated folders, complete once a ``_DONE`` file is there."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the cluster shares; one is set only where a session has none, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Checkpointer:
    """Saves to and loads from ``path``, which may lie in any store that Spark writes to.

    ``fallback`` is read where ``path`` has no complete checkpoint. ``group`` is a folder below ``path``.
    """

    def __init__(self, spark: SparkSession, path: str, group: str = "", fallback: str | None = None):
        self.spark, self.path, self.fallback = spark, f"{path.rstrip('/')}/{group}".rstrip("/"), fallback
        self._jvm = spark.sparkContext._jvm

    @classmethod
    def temporary(cls, spark: SparkSession) -> Checkpointer:
        """One with a new folder of its own in the shared folder."""
        return cls(spark, shared_folder(spark), f"checkpoints-{uuid.uuid4().hex}")

    def _fs(self, path: str):  # noqa: ANN202
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _complete(self, root: str) -> list[str]:
        fs, where = self._fs(root)
        if not fs.exists(where):
            return []
        found = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory())
        return [p for p in found if fs.exists(self._fs(f"{p}/_DONE")[1])]

    def save(self, tables: dict[str, DataFrame], meta: dict | None = None, keep_latest: int = 1) -> str:
        """Writes every table, then ``_DONE``; older complete checkpoints beyond ``keep_latest`` go. Returns the folder."""
        if keep_latest < 1:
            raise ValueError("keep_latest must be positive")
        out = f"{self.path}/{datetime.now(UTC).strftime('%Y-%m-%dT%H-%M-%S.%f')}"
        for name, df in tables.items():
            df.write.parquet(f"{out}/{name}")
        about = json.dumps({"tables": sorted(tables), "meta": meta or {}})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{out}/about")
        fs, where = self._fs(f"{out}/_DONE")
        fs.create(where).close()
        for old in self._complete(self.path)[:-keep_latest]:
            fs.delete(self._fs(old)[1], True)
        return out

    def latest(self) -> str | None:
        """The newest complete checkpoint; the fallback's only where there is none."""
        own = self._complete(self.path)
        if own:
            return own[-1]
        other = self._complete(self.fallback) if self.fallback else []
        return other[-1] if other else None

    def load(self, folder: str | None = None) -> tuple[dict[str, DataFrame], dict]:
        """(tables, meta) of a folder or the latest; FileNotFoundError where there is none."""
        folder = folder or self.latest()
        if folder is None:
            raise FileNotFoundError(f"no complete checkpoint in {self.path}")
        done = json.loads(self.spark.read.text(f"{folder}/about").first()[0])
        return {n: self.spark.read.parquet(f"{folder}/{n}") for n in done["tables"]}, done["meta"]
