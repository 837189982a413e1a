"""Structured Streaming: patterns over live steps, a table's counters as state, micro-batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandloom.operators.limiter import RateLimiter


class _Admission(StatefulProcessor):
    """Counters of one table; each micro-batch's operations pass in ``op_seq`` order."""

    def __init__(self, limiter: RateLimiter):
        self.limiter = limiter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", T.StructType([T.StructField(n, T.LongType()) for n in ("inserts", "samples", "deletes")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ins, sam, dele = self.counters.get() if self.counters.exists() else (0, 0, 0)
        batch = pd.concat(list(rows)).sort_values("op_seq")
        out = []
        for op in batch["op"]:
            if op == "insert":
                ok = bool(self.limiter.can_insert(ins, sam, dele))
                ins += ok
            elif op == "sample":
                ok = bool(self.limiter.can_sample(ins, sam, dele))
                sam += ok
            else:
                ok, dele = True, dele + 1
            out.append(ok)
        self.counters.update((ins, sam, dele))
        yield pd.DataFrame({"table": key[0], "op_seq": batch["op_seq"].to_numpy(), "op": batch["op"].to_numpy(), "admitted": out})

    def close(self) -> None:
        pass


def admit_stream(ops: DataFrame, limiter: RateLimiter) -> DataFrame:
    """The streaming form of ``limiter.admit``: table, op_seq, op, admitted. Needs the RocksDB state store."""
    return ops.groupBy("table").transformWithStateInPandas(_Admission(limiter), "table string, op_seq long, op string, admitted boolean", "Append", "None")


class _LastSteps(StatefulProcessor):
    """The last ``n - 1`` rows of each stream are kept as state; with every new row they give a window of ``n``."""

    def __init__(self, columns: list[str], order: str, n: int, schema: T.StructType):
        self.columns, self.order, self.n, self.schema = columns, order, n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = [self.order, *self.columns]
        history = [tuple(r) for r in self.kept.get()]
        batch = pd.concat(list(rows)).sort_values(self.order)
        out = []
        for row in batch[names].itertuples(index=False, name=None):
            history.append(row)
            if len(history) >= self.n:
                last = history[-self.n :]
                out.append((*key, row[0], *[[r[i + 1] for r in last] for i in range(len(self.columns))]))
                del history[: -self.n]
        self.kept.put(history[-(self.n - 1) :] if self.n > 1 else [])
        stream = [f"_k{i}" for i in range(len(key))]
        yield pd.DataFrame(out, columns=[*stream, *names])

    def close(self) -> None:
        pass


def sliding_stream(steps: DataFrame, stream: Sequence[str], order: str, columns: Sequence[str], n: int) -> DataFrame:
    """At each new step of a stream the last ``n`` cells of the columns, across micro-batches.

    Rows of one micro-batch are put in ``order``; a row that comes in a later micro-batch than rows after it is taken
    as it comes.
    """
    if n < 1:
        raise ValueError("n must be positive")
    types = {f.name: f.dataType for f in steps.schema.fields}
    state = T.StructType([T.StructField(c, types[c]) for c in [order, *columns]])
    out = T.StructType([T.StructField(f"_k{i}", types[c]) for i, c in enumerate(stream)] + [T.StructField(order, types[order])] + [T.StructField(c, T.ArrayType(types[c])) for c in columns])
    made = steps.groupBy(*stream).transformWithStateInPandas(_LastSteps(list(columns), order, n, state), out, "Append", "None")
    return made.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(stream)], order, *columns)


def apply_batches(steps: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):  # noqa: ANN201
    """Writes ``transform`` of every micro-batch of whole episodes to ``path``, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its folder, so that each step counts once.
    """
    return steps.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: transform(df).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
