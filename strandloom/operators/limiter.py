"""Rate limits: when a table may be sampled from or inserted into, and which operations of a log they admit."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ranges import by_ranges, previous, running_sum

HUGE = sys.float_info.max


@dataclass(frozen=True)
class RateLimiter:
    samples_per_insert: float
    min_size_to_sample: int
    min_diff: float
    max_diff: float

    def __post_init__(self) -> None:
        if self.samples_per_insert <= 0 or self.min_size_to_sample < 1 or self.min_diff > self.max_diff:
            raise ValueError("samples_per_insert and min_size_to_sample must be positive, and min_diff at most max_diff")

    def can_sample(self, inserts: Column | int, samples: Column | int, deletes: Column | int, n: int = 1):  # noqa: ANN201
        return (inserts - deletes >= self.min_size_to_sample) & (inserts * self.samples_per_insert - samples - n >= self.min_diff)

    def can_insert(self, inserts: Column | int, samples: Column | int, deletes: Column | int, n: int = 1):  # noqa: ANN201
        return (inserts + n - deletes <= self.min_size_to_sample) | ((inserts + n) * self.samples_per_insert - samples <= self.max_diff)


def MinSize(n: int) -> RateLimiter:  # noqa: N802
    if n < 1:
        raise ValueError("the minimum size must be positive")
    return RateLimiter(1.0, n, -HUGE, HUGE)


def SampleToInsertRatio(samples_per_insert: float, min_size_to_sample: int, error_buffer: float | tuple[float, float]) -> RateLimiter:  # noqa: N802
    """A number is a margin on both sides of the ratio at the minimum size; a pair gives the bounds themselves."""
    if samples_per_insert <= 0 or min_size_to_sample < 1:
        raise ValueError("samples_per_insert and min_size_to_sample must be positive")
    if isinstance(error_buffer, tuple):
        low, high = error_buffer
    else:
        if error_buffer < max(1.0, samples_per_insert):
            raise ValueError("error_buffer must be at least max(1, samples_per_insert), or the table blocks at once")
        centre = samples_per_insert * min_size_to_sample
        low, high = centre - error_buffer, centre + error_buffer
    if high - low < 2 * max(1.0, samples_per_insert):
        raise ValueError("error_buffer is too small: the table would block")
    if high < samples_per_insert * min_size_to_sample:
        warnings.warn("inserts will wait before the minimum size is reached: the upper bound lies below samples_per_insert * min_size_to_sample", stacklevel=2)
    if low > samples_per_insert * min_size_to_sample:
        warnings.warn("samples will wait beyond the minimum size: the lower bound lies above samples_per_insert * min_size_to_sample", stacklevel=2)
    return RateLimiter(samples_per_insert, min_size_to_sample, low, high)


def Queue(size: int) -> RateLimiter:  # noqa: N802
    if size < 1:
        raise ValueError("the size must be positive")
    return RateLimiter(1.0, 1, 0.0, float(size))


Stack = Queue


def admit(ops: DataFrame, limiter: RateLimiter, keys: tuple[str, ...] = ("table",), order: str = "op_seq") -> DataFrame:
    """Adds ``admitted`` to a log of ops (``op``: insert, sample or delete) in the given order.

    A refused insert or sample changes nothing; deletes always pass. What is admitted depends on all that went before,
    so each table is one ordered pass over a sorted partition, of which only three counters are held.
    """
    names = ops.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ins, sam, dele = object(), 0, 0, 0
        for batch in batches:
            who = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            out = []
            for key, op in zip(who, batch.column("op").to_pylist(), strict=True):
                if key != current:
                    current, ins, sam, dele = key, 0, 0, 0
                if op == "insert":
                    ok = bool(limiter.can_insert(ins, sam, dele))
                    ins += ok
                elif op == "sample":
                    ok = bool(limiter.can_sample(ins, sam, dele))
                    sam += ok
                else:
                    ok, dele = True, dele + 1
                out.append(ok)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "admitted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ops.schema.fields) + ", admitted boolean"
    return ops.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def limiter_state(ops: DataFrame, limiter: RateLimiter, keys: tuple[str, ...] = ("table",)) -> DataFrame:
    """Counters and what the limiter allows next, of a log of admitted operations; a partial aggregate."""
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    state = ops.groupBy(*keys).agg(n("insert").alias("inserts"), n("sample").alias("samples"), n("delete").alias("deletes"))
    c = [F.col(x) for x in ("inserts", "samples", "deletes")]
    return state.withColumns({"can_sample": limiter.can_sample(*c), "can_insert": limiter.can_insert(*c)})


def queue_replay(ops: DataFrame, keys: tuple[str, ...] = ("table",), order: str = "op_seq") -> DataFrame:
    """(keys, sample op, key): what a queue of items sampled once gives to each sample of an admitted log (see :func:`admit`).

    The k-th sample gets the k-th insert: both are numbered, by ranges of the log, and joined.
    """
    names = list(keys)
    numbered = ops.where("op IN ('insert', 'sample')").select(*names, "op", "key", order)
    numbered = running_sum(by_ranges(numbered, [*names, "op"], [order]), [*names, "op"], [order], F.lit(1), "_k")
    ins = numbered.where("op = 'insert'").select(*names, "key", "_k")
    sam = numbered.where("op = 'sample'").select(*names, F.col(order).alias("sampled_at"), "_k")
    return sam.join(ins, [*names, "_k"]).drop("_k")


def stack_replay(ops: DataFrame, keys: tuple[str, ...] = ("table",), order: str = "op_seq") -> DataFrame:
    """The same for a stack: a sample takes the newest insert that no sample has taken.

    Inserts and samples match like brackets: an insert at depth d is taken by the first later sample that leaves depth
    d - 1. Depths are running sums, and matches the neighbours of equal depth; both are found by ranges.
    """
    names = list(keys)
    signed = by_ranges(ops.where("op IN ('insert', 'sample')").select(*names, "op", "key", order), names, [order])
    signed = running_sum(signed, names, [order], F.when(F.col("op") == "insert", 1).otherwise(-1), "_d").drop("_part")
    level = signed.withColumn("_level", F.when(F.col("op") == "insert", F.col("_d")).otherwise(F.col("_d") + 1))
    level = previous(by_ranges(level, [*names, "_level"], [order]), [*names, "_level"], [order], ["op", "key"], "_before")
    return level.where("op = 'sample' AND _before.op = 'insert'").select(*names, F.col("_before.key").alias("key"), F.col(order).alias("sampled_at"))
