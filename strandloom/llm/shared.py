"""Tables cut into the folder that the cluster shares, so that a lost executor never costs a recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session that has none (as in tests) gets one, a cluster never."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and returns it as read from there; its lineage ends in those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of a table whose files make fewer parts than there are cores (one small file, say), dealt over all cores.

    For queries whose work per row is heavy. A table of many parts stays as it is and is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan.select(F.spark_partition_id().alias("part")).distinct().count()  # reads no column
    return scan.repartition(cores) if 0 < parts < cores else scan


def sweep(spark: SparkSession) -> None:
    """Deletes every table that :func:`cut` wrote in this application. Call it once the results are stored."""
    jvm = spark.sparkContext._jvm
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes that a hint may broadcast, and what a row costs in the joined table beside its own bytes.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 40


def small_enough(keys: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``keys`` (a written table of rows of some ``row_bytes``) with a broadcast hint if a count shows that they take at
    most BROADCAST_BYTES; else they are joined by a shuffle."""
    most = BROADCAST_BYTES // (row_bytes + ROW_BYTES)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, floor: int = 500, most_hot: int = 20_000, how: str = "inner") -> DataFrame:
    """Join (``how``: inner or left) of ``rows`` with ``keyed``, a written table with one row for each key and in ``n`` how
    many rows have it.

    Rows of the keys that have more than 1 / ``most_hot`` of all rows (of which there are fewer than ``most_hot``, so
    that they can be broadcast) stay where they are; the others are shuffled. No task gets a hot key's rows.
    """
    found = keyed.agg(F.sum(n).alias("total"), F.max(n).alias("top")).first()
    limit = max(floor, (found["total"] or 0) // most_hot)
    if (found["top"] or 0) <= limit:
        return rows.join(keyed.drop(n), on, how)
    hot = F.broadcast(keyed.where(F.col(n) > limit).drop(n))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(n) <= limit).drop(n), on, how)
    return rows.join(hot, on).unionByName(cold)
