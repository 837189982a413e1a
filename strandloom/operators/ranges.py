"""Running sums and neighbours in a total order, by ranges: no task gets all rows of a key, however many it has.

Rows are sorted by ranges of (keys, order) into the folder in ``spark.checkpoint.dir``. A range's rows are worked on in
one task, and what the ranges before it amount to comes from one row for each key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.checkpoint import shared_folder


def by_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with ``_part``, the number of their range: ranges are numbered in the order of ``keys``, then ``order``.

    The plan of ``rows`` runs twice, as Spark samples it for the bounds of the ranges; equal rows share a range.
    """
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()


def running_sum(placed: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, below: int | None = None) -> DataFrame:
    """Adds to rows of :func:`by_ranges` the sum of the whole number ``value`` up to and with each row, within its keys.

    Rows that tie in ``order`` are summed one after the other, so ``order`` should be total. With ``below``, ranges that
    start at that sum or beyond are left out: for sums that do not fall, of which only the lower are wanted.
    """
    sums = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = starts if below is None else starts.where(F.col("_start") < below)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(starts, [*keys, "_part"]).withColumn(name, F.col("_start") + F.sum(value).over(inside)).drop("_start")


def previous(placed: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Adds to rows of :func:`by_ranges` a struct of ``columns`` of the row before, within its keys; null for the first."""
    row = F.struct(*columns)
    last = placed.groupBy(*keys, "_part").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part")
    carried = last.select(*keys, "_part", F.lag("_last").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return placed.join(carried, [*keys, "_part"]).withColumn(name, F.coalesce(F.lag(row).over(inside), "_carried")).drop("_carried")
