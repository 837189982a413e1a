"""Array expressions over trajectories: slices, gathers, stacks, priorities. All are Column expressions for the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def gather(values: Column, places: Sequence[int]) -> Column:
    """The cells at ``places`` (negative ones count from the end); null where a place lies outside."""
    return F.array(*[F.get(values, F.lit(p) if p >= 0 else F.size(values) + p) for p in places])


def py_slice(values: Column, start: int | None, stop: int | None, step: int = 1) -> Column:
    """``values[start:stop:step]`` as Python has it, for a positive step."""
    if step <= 0:
        raise ValueError("step must be positive")
    n = F.size(values)
    place = lambda x, default: default if x is None else F.greatest(F.lit(0), F.least(n, F.lit(x) if x >= 0 else n + x))
    lo, hi = place(start, F.lit(0)), place(stop, n)
    part = F.slice(values, lo + 1, F.greatest(F.lit(0), hi - lo))
    return part if step == 1 else F.filter(part, lambda x, i: i % step == 0)


def squeeze(values: Column) -> Column:
    """The one cell of a column that must have length 1."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.raise_error(F.lit("squeeze needs a column of length 1")))


def frame_stack(frames: Column, size: int, stride: int = 1) -> Column:
    """Every ``stride``-th run of ``size`` consecutive frames; empty for a shorter column."""
    last = F.size(frames) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(frames, i + 1, size))


def td_error_priority(errors: Column, max_weight: float) -> Column:
    """``w * max|e| + (1 - w) * mean|e|`` of an array of temporal-difference errors."""
    if not 0 <= max_weight <= 1:
        raise ValueError("max_weight must lie between 0 and 1")
    size = F.transform(errors, lambda e: F.abs(e.cast("double")))
    mean = F.aggregate(size, F.lit(0.0), lambda a, e: a + e) / F.size(size)
    return F.when(F.size(size) > 0, max_weight * F.array_max(size) + (1 - max_weight) * mean)


def column_length(slices: Column) -> Column:
    """Cells that a column of chunk slices stands for."""
    return F.aggregate(slices, F.lit(0).cast("long"), lambda n, s: n + s["length"])


def column_offset(slices: Column) -> Column:
    """Where a column's first slice starts in its chunk; null for a column without slices."""
    return F.get(slices, F.lit(0))["offset"]


def require_cells(values: Column) -> Column:
    """The column; an error where a cell is missing, because it has left the history or was never set."""
    return F.when(F.exists(values, lambda x: x.isNull()), F.raise_error(F.lit("a column refers to cells that are missing"))).otherwise(values)


def same_shape(values: Column) -> Column:
    """Whether the cells of a column, themselves arrays, are equally long; a missing cell has no shape to agree."""
    return F.forall(values, lambda x: F.coalesce(F.size(x) == F.size(F.get(values, F.lit(0))), F.lit(False)))


def require_same_shape(values: Column) -> Column:
    """The column; an error where its cells differ in shape."""
    return F.when(same_shape(values), values).otherwise(F.raise_error(F.lit("a column refers to cells of different shapes")))


def chunk_keys(columns: Column) -> Column:
    """Distinct chunk keys of a flat trajectory, in the order first seen."""
    return F.array_distinct(F.flatten(F.transform(columns, lambda c: F.transform(c["slices"], lambda s: s["chunk_key"]))))


def is_timestep_trajectory(columns: Column) -> Column:
    """Whether all columns have the same slices, each reading its own column, and no column is squeezed or has a gap."""
    plain = lambda c: F.transform(c["slices"], lambda s: F.struct(s["chunk_key"].alias("k"), s["offset"].alias("o"), s["length"].alias("n")))
    first = plain(F.get(columns, F.lit(0)))
    inner = lambda c: F.forall(c["slices"], lambda s: s["length"] > 0) & F.forall(F.sequence(F.lit(1), F.size(c["slices"])), lambda i: (i == 1) | (F.get(c["slices"], i - 1)["offset"] == 0))
    own = F.forall(F.transform(columns, lambda c, i: F.forall(c["slices"], lambda s: s["index"] == i)), lambda ok: ok)
    return (F.size(columns) > 0) & own & F.forall(columns, lambda c: (plain(c) == first) & ~c["squeeze"] & (F.size(c["slices"]) > 0) & inner(c))
