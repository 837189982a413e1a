"""Chunks: consecutive cells of one column, their ranges, encodings, references and liveness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_chunks(steps: DataFrame, stream: Sequence[str], step: str, column: str, max_chunk_length: int, flush: Column | None = None) -> DataFrame:
    """One row per non-null cell: stream columns, step, ``chunk_no``, ``offset`` in the chunk, and the cell.

    A chunk closes after ``max_chunk_length`` cells, after a step where ``flush`` is true (whether or not it has a cell),
    or at the end of the stream.
    """
    if max_chunk_length < 1:
        raise ValueError("max_chunk_length must be positive")
    w = Window.partitionBy(*stream).orderBy(step)
    if flush is None:
        cells = steps.where(F.col(column).isNotNull()).select(*stream, step, column, (F.row_number().over(w) - 1).alias("_at"))
        return cells.select(*stream, step, column, F.floor(F.col("_at") / max_chunk_length).cast("long").alias("chunk_no"), (F.col("_at") % max_chunk_length).alias("offset"))
    before = F.sum(F.coalesce(flush.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = steps.select(*stream, step, column, F.coalesce(before, F.lit(0)).alias("_part")).where(F.col(column).isNotNull())
    cells = cells.withColumn("offset", (F.row_number().over(Window.partitionBy(*stream, "_part").orderBy(step)) - 1) % max_chunk_length)
    return cells.select(*stream, step, column, (F.sum((F.col("offset") == 0).cast("long")).over(w) - 1).alias("chunk_no"), "offset")


def build_chunks(steps: DataFrame, stream: Sequence[str], step: str, column: str, max_chunk_length: int, flush: Column | None = None) -> DataFrame:
    """One row per chunk: its range of steps, whether steps are missing in it, its cells, and a key made from its place."""
    cells = assign_chunks(steps, stream, step, column, max_chunk_length, flush)
    made = cells.groupBy(*stream, "chunk_no").agg(
        F.min(step).alias("start"), F.max(step).alias("end"), F.count("*").alias("num_rows"),
        F.sort_array(F.collect_list(F.struct(step, column))).alias("_cells"),
    )
    return made.select(
        F.xxhash64(*stream, F.lit(column), "chunk_no").alias("chunk_key"), *stream, F.lit(column).alias("column"), "chunk_no", "start", "end", "num_rows",
        (F.col("end") - F.col("start") + 1 != F.col("num_rows")).alias("sparse"), F.col(f"_cells.{column}").alias("data"),
    )


def merge_slices(refs: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Runs of references to following cells of one chunk become slices (chunk_key, offset, length), in order.

    ``refs`` has ``place`` in the trajectory's column, ``chunk_key`` and ``offset``. A gap starts a new slice.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    new = F.coalesce((F.lag("chunk_key").over(w) != F.col("chunk_key")) | (F.lag("offset").over(w) + 1 != F.col("offset")), F.lit(True))
    runs = refs.withColumn("_new", new.cast("int")).withColumn("slice_no", F.sum("_new").over(w) - 1)
    return runs.groupBy(*keys, "slice_no").agg(F.min_by("chunk_key", place).alias("chunk_key"), F.min("offset").alias("offset"), F.count("*").alias("length"))


def timestep_slices(chunks: DataFrame, keys: Sequence[str], order: str, offset: int, length: int) -> DataFrame:
    """Slices of the chunks (with ``num_rows``) that hold ``length`` rows from row ``offset`` of their concatenation on."""
    before = F.coalesce(F.sum("num_rows").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lo = F.greatest(F.lit(0), F.lit(offset) - F.col("_before"))
    hi = F.least(F.col("num_rows"), F.lit(offset + length) - F.col("_before"))
    return chunks.withColumn("_before", before).where(hi > lo).select(*keys, order, lo.cast("long").alias("offset"), (hi - lo).cast("long").alias("length"))


def delta_encode(cells: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Each integer cell less the one before it in its chunk; the first stays. Reversed by :func:`delta_decode`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return cells.withColumn(column, F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def delta_decode(cells: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    return cells.withColumn(column, F.sum(column).over(Window.partitionBy(*keys).orderBy(order)))


def delta_encode_array(values):  # noqa: ANN001, ANN201
    """The same for an array column, as an expression."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def reference_counts(refs: DataFrame) -> DataFrame:
    """(chunk_key, num_items): the items that hold at least one slice of the chunk. ``refs``: key, chunk_key."""
    return refs.select("key", "chunk_key").distinct().groupBy("chunk_key").agg(F.count("*").alias("num_items"))


def live_chunks(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return chunks.join(refs.select("chunk_key").distinct(), "chunk_key", "left_semi")


def orphan_chunks(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    return chunks.join(refs.select("chunk_key").distinct(), "chunk_key", "left_anti")


def uncompressed_bytes(chunks: DataFrame, cell_bytes: int) -> DataFrame:
    return chunks.withColumn("uncompressed_bytes", F.size("data").cast("long") * cell_bytes)
