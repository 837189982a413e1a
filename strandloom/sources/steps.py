"""Steps from ordered rows: numbering, episodes, partial steps, sequences, items of the last n steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_steps(rows: DataFrame, stream: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``step``, from 0 in each stream."""
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)) - 1)


def number_episodes(steps: DataFrame, stream: Sequence[str], order: Sequence[str], is_last: Column) -> DataFrame:
    """Adds ``episode``: the number of episodes that earlier steps of the stream have closed (a null flag closes none)."""
    before = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("episode", F.coalesce(F.sum(F.coalesce(is_last.cast("long"), F.lit(0))).over(before), F.lit(0).cast("long")))


def merge_partial_steps(parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per step from several partial appends; a column that two parts fill is an error."""
    once = lambda c: F.when(F.count(c) > 1, F.raise_error(F.lit(f"column {c} was set twice in one step"))).otherwise(F.max(c)).alias(c)
    return parts.groupBy(*keys).agg(*[once(c) for c in columns])


def open_steps(parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Steps that partial appends have begun and not filled: (keys, ``missing``: how many of the columns have no cell)."""
    missing = sum((F.when(F.count(c) == 0, 1).otherwise(0) for c in columns), F.lit(0))
    return parts.groupBy(*keys).agg(missing.alias("missing")).where("missing > 0")


def usable_steps(steps: DataFrame, stream: Sequence[str], episode: str, order: Sequence[str], lost: Column) -> DataFrame:
    """Steps of which no trajectory misses data: from the first lost step of an episode on, nothing of it can be used."""
    so_far = Window.partitionBy(*stream, episode).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("_lost", F.max(F.coalesce(lost, F.lit(False)).cast("int")).over(so_far)).where("_lost = 0").drop("_lost")


def append_sequence(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Splits array columns into steps; arrays of a row must be equally long."""
    first = F.size(columns[0])
    equal = F.lit(True)
    for c in columns[1:]:
        equal = equal & (F.size(c) == first)
    zipped = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("columns of a sequence differ in length")))
    return rows.select(*keys, F.posexplode(zipped).alias("step", "_cells")).select(*keys, "step", *[F.col(f"_cells.{c}").alias(c) for c in columns])


def last_steps(steps: DataFrame, stream: Sequence[str], order: Sequence[str], columns: Sequence[str], num_timesteps: int) -> DataFrame:
    """At each step that has enough history, the last ``num_timesteps`` cells of all columns."""
    if num_timesteps < 1:
        raise ValueError("num_timesteps must be positive")
    w = Window.partitionBy(*stream).orderBy(*order)
    frame = w.rowsBetween(-(num_timesteps - 1), 0)
    cells = F.collect_list(F.struct(*columns)).over(frame)
    return steps.select(*stream, *order, cells.alias("_cells")).where(F.size("_cells") == num_timesteps).select(*stream, *order, *[F.col(f"_cells.{c}").alias(c) for c in columns])


def insert(rows: DataFrame, priorities: dict[str, float]) -> DataFrame:
    """One item per row and table, all of them over the row's own one-step chunk."""
    if not priorities:
        raise ValueError("an insert needs at least one table")
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(float(p)).alias("priority")) for t, p in sorted(priorities.items())])
    return rows.select("*", F.inline(tables))
