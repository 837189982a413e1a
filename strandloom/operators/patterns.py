"""The pattern language: sliding projections over ordered steps, with conditions and priorities, as window expressions.

A pattern refers to cells of the latest steps of an episode: ``step["x"][-1]`` is the newest cell of x, ``[-3:]`` the
last three, ``[-4:-1:2]`` every second of a slice. A config names the pattern's table, the conditions that must all
hold, and the priority. Everything runs in one window per episode; only ``steps_since_applied``, whose value depends on
where a config fired before, is a sequential pass, which carries one counter per stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.arrays import td_error_priority


@dataclass(frozen=True)
class Node:
    """A reference into the history of one column. ``stop`` None with a start is an open slice; ``squeeze`` one cell."""

    column: str
    start: int | None
    stop: int | None
    step: int | None = None
    squeeze: bool = False

    def check(self) -> None:
        if not self.column:
            raise ValueError("a pattern node needs a column")
        if self.start is None and self.stop is None:
            raise ValueError("at least one of start and stop must be set")
        if self.start is not None and self.start >= 0:
            raise ValueError("start must be negative")
        if self.stop is not None and self.stop > 0:
            raise ValueError("stop must not be positive")
        if self.start is None and self.stop == 0:
            raise ValueError("stop must be negative when there is no start")
        if self.start is not None and self.stop is not None and self.start >= self.stop:
            raise ValueError("start must come before stop")
        if self.step is not None and (self.start is None or self.step <= 0):
            raise ValueError("step needs a start and must be positive")

    @property
    def age(self) -> int:
        """How many steps back the oldest cell lies (1: the latest step)."""
        return -(self.start if self.start is not None else self.stop)

    @property
    def length(self) -> int:
        if self.squeeze or self.start is None:
            return 1
        return math.ceil(((self.stop or 0) - self.start) / (self.step or 1))


class ColumnRef:
    def __init__(self, column: str):
        self.column = column

    def __getitem__(self, at: int | slice) -> Node:
        if isinstance(at, slice):
            start, stop = at.start, at.stop
            if start is None:
                raise ValueError("a slice needs a start")
            node = Node(self.column, start, stop or 0, at.step)
        else:
            node = Node(self.column, at, at + 1, None, True)
        node.check()
        return node


class ReferenceStep:
    """A symbolic step: ``step["observation"]`` or ``step["nested.field"]`` refers to a column."""

    def __getitem__(self, column: str) -> ColumnRef:
        return ColumnRef(column)


def create_reference_step() -> ReferenceStep:
    return ReferenceStep()


def pattern_from_transform(transform: Callable[[ReferenceStep], Mapping[str, Any]]) -> Mapping[str, Any]:
    return transform(ReferenceStep())


# ---- conditions


@dataclass(frozen=True)
class Test:
    """One comparison: ``left`` names what is compared, ``op`` is one of ge, eq, mod; ``inverse`` negates it."""

    left: str
    op: str
    value: int
    mod: int = 0
    inverse: bool = False
    column: str = ""

    def check(self) -> None:
        if self.left not in ("step_index", "steps_since_applied", "buffer_length", "is_end_episode", "data") or self.op not in ("ge", "eq", "mod"):
            raise ValueError("a condition needs a left side and a comparison")
        if self.op == "mod" and (self.mod <= 0 or self.value < 0):
            raise ValueError("a modulo must be positive and its remainder must not be negative")
        if self.left == "is_end_episode" and (self.op != "eq" or self.value != 1 or self.inverse):
            raise ValueError("is_end_episode can only be compared with 1")

    def of(self, x: Column) -> Column:
        if self.op == "mod":
            return (x % self.mod != self.value) if self.inverse else (x % self.mod == self.value)
        if self.op == "ge":
            return x < self.value if self.inverse else x >= self.value
        return x != self.value if self.inverse else x == self.value

    def holds(self, x: int) -> bool:
        found = x % self.mod == self.value if self.op == "mod" else x >= self.value if self.op == "ge" else x == self.value
        return found != self.inverse


class Side:
    def __init__(self, left: str, column: str = "", mod: int = 0):
        self.left, self.column, self.mod = left, column, mod

    def _test(self, op: str, value: int, inverse: bool = False) -> Test:
        test = Test(self.left, "mod" if self.mod else op, int(value), self.mod, inverse, self.column)
        test.check()
        return test

    def __eq__(self, v):  # noqa: ANN001, ANN204
        return self._test("eq", v)

    def __ne__(self, v):  # noqa: ANN001, ANN204
        return self._test("eq", v, True)

    def __ge__(self, v):  # noqa: ANN001, ANN204
        return self._test("ge", v)

    def __gt__(self, v):  # noqa: ANN001, ANN204
        return self._test("ge", v + 1)

    def __lt__(self, v):  # noqa: ANN001, ANN204
        return self._test("ge", v, True)

    def __le__(self, v):  # noqa: ANN001, ANN204
        return self._test("ge", v + 1, True)

    __hash__ = None

    def __mod__(self, n: int) -> Side:
        if n <= 0:
            raise ValueError("a modulo must be positive")
        return Side(self.left, self.column, n)


class Condition:
    step_index = staticmethod(lambda: Side("step_index"))
    steps_since_applied = staticmethod(lambda: Side("steps_since_applied"))
    buffer_length = staticmethod(lambda: Side("buffer_length"))
    is_end_episode = staticmethod(lambda: Side("is_end_episode") == 1)
    data = staticmethod(lambda column: Side("data", column))


# ---- configs


@dataclass(frozen=True)
class Priority:
    value: float = 1.0
    td_column: str | None = None
    max_weight: float = 0.0


def constant_priority(value: float) -> Priority:
    if value < 0 or value != value:
        raise ValueError("a priority must not be negative or NaN")
    return Priority(value)


def td_error(max_weight: float, column: str) -> Priority:
    """Priority from the pattern's node on ``column``; 0 if the pattern has none, the last if it has several."""
    if not 0 <= max_weight <= 1:
        raise ValueError("max_weight must lie between 0 and 1")
    return Priority(0.0, column, max_weight)


@dataclass(frozen=True)
class PatternConfig:
    pattern: Mapping[str, Any]
    table: str
    conditions: tuple[Test, ...] = ()
    priority: Priority = field(default_factory=Priority)

    @property
    def nodes(self) -> dict[str, Node]:
        """Nodes by output name, nested names joined with ``/``; dict keys in sorted order."""
        out: dict[str, Node] = {}

        def walk(prefix: str, x: Any) -> None:
            if isinstance(x, Node):
                out[prefix] = x
            elif isinstance(x, Mapping):
                for k in sorted(x):
                    walk(f"{prefix}/{k}" if prefix else str(k), x[k])
            elif isinstance(x, Sequence) and not isinstance(x, str):
                for i, y in enumerate(x):
                    walk(f"{prefix}/{i}" if prefix else str(i), y)
            else:
                raise ValueError(f"a pattern holds nodes only, not {type(x).__name__}")

        walk("", self.pattern)
        return out

    @property
    def history(self) -> int:
        return max(n.age for n in self.nodes.values())

    def used(self) -> list[str]:
        return list(dict.fromkeys([n.column for n in self.nodes.values()] + [t.column for t in self.conditions if t.column]))


def create_config(pattern: Mapping[str, Any], table: str, conditions: Sequence[Test] = (), priority: Priority | None = None) -> PatternConfig:
    """A checked config. Unless a condition bounds the buffer's length, one for the whole history is added."""
    config = PatternConfig(pattern, table, tuple(conditions), priority or Priority())
    if not table:
        raise ValueError("a config needs a table")
    if not config.nodes:
        raise ValueError("a pattern must not be empty")
    for node in config.nodes.values():
        node.check()
    for test in config.conditions:
        test.check()
    if not any(t.left == "buffer_length" and t.op == "ge" and not t.inverse and t.value >= config.history for t in config.conditions):
        config = replace(config, conditions=(*config.conditions, Condition.buffer_length() >= config.history))
    return config


def infer_signature(configs: Sequence[PatternConfig], steps: T.StructType) -> T.StructType:
    """The common output schema of configs that write one table; arrays of differing lengths are one type."""
    if not configs:
        raise ValueError("at least one config is needed")
    if len({c.table for c in configs}) > 1:
        raise ValueError("configs of one signature must share a table")
    found = {}
    for config in configs:
        fields = {}
        for name, node in config.nodes.items():
            kind = steps
            for part in node.column.split("."):
                kind = kind[part].dataType
            fields[name] = kind if node.squeeze else T.ArrayType(kind)
        if found and found != fields:
            raise ValueError("configs of one table must have the same structure, types and ranks")
        found = fields
    return T.StructType([T.StructField(k, v) for k, v in found.items()])


# ---- compilation


def _cell(node: Node, window) -> Column:  # noqa: ANN001
    """Value of the node at each step, and null where a cell is missing or null."""
    if node.squeeze or node.start is None:
        return F.lag(F.col(node.column), node.age - 1).over(window)
    stop = -(node.stop or 0)
    frame = F.collect_list(F.struct(F.col(node.column).alias("v"))).over(window.rowsBetween(-(node.age - 1), -stop))
    part = frame if not node.step or node.step == 1 else F.filter(frame, lambda x, i: i % node.step == 0)
    whole = (F.size(frame) == node.age - stop) & ~F.exists(part, lambda x: x["v"].isNull())
    return F.when(whole, F.transform(part, lambda x: x["v"]))


def apply_pattern(steps: DataFrame, config: PatternConfig, stream: Sequence[str], order: Sequence[str], episode: str | None = None, end: Column | None = None) -> DataFrame:
    """One row per item: the stream and order columns, ``episode`` if given, ``table``, ``priority``, the pattern's columns.

    ``stream`` says whose steps belong together, ``episode`` where histories start anew (None: patterns span
    episodes), ``end`` which steps close an episode (needed for is_end_episode). A step whose used columns are all null
    is not evaluated, but counts for step_index. Null, float and missing data conditions are false, inverse or not. An
    empty table gives no rows.
    """
    return apply_patterns(steps, [config], stream, order, episode, end).drop("config_idx")


def _passed(steps: DataFrame, config: PatternConfig, number: Column) -> tuple[Column, list[Test]]:
    """Whether a step passes the conditions that it can settle by itself, and the conditions that it cannot."""
    sides = {"step_index": number - 1, "buffer_length": F.least(number, F.lit(config.history)), "is_end_episode": F.col("_end").cast("int")}
    passed, later = F.lit(True), []
    for test in config.conditions:
        if test.left == "steps_since_applied":
            later.append(test)
        elif test.left == "data":
            numeric = isinstance(steps.select(test.column).schema[0].dataType, (T.IntegralType, T.BooleanType))
            passed = passed & (F.coalesce(test.of(F.col(test.column).cast("long")), F.lit(False)) if numeric else F.lit(False))
        else:
            passed = passed & test.of(sides[test.left])
    return passed, later


def _item(config: PatternConfig, index: int, cells: Mapping[Node, str]) -> Column:
    """The item that a config makes of a step, as a struct."""
    td = [node for node in config.nodes.values() if node.column == config.priority.td_column]
    if config.priority.td_column is None:
        priority = F.lit(float(config.priority.value))
    elif not td:
        priority = F.lit(0.0)
    else:
        cell = F.col(cells[td[-1]])
        priority = td_error_priority(F.array(cell) if td[-1].squeeze else cell, config.priority.max_weight)
    own = [F.col(cells[node]).alias(name) for name, node in sorted(config.nodes.items())]
    return F.struct(F.lit(config.table).alias("table"), priority.alias("priority"), F.lit(index).alias("config_idx"), F.struct(*own).alias("_columns"))


def _since_applied(d: DataFrame, tests: list[Test], stream: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Rows at which the config fires: sorted partitions are read once, with one counter for the stream at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, since = object(), 0
        for batch in batches:
            who = list(zip(*[batch.column(c).to_pylist() for c in stream], strict=True)) if stream else [()] * batch.num_rows
            fired = []
            for key, ready in zip(who, batch.column("_ready").to_pylist(), strict=True):
                if key != current:
                    current, since = key, 0
                since += 1
                hit = bool(ready) and all(t.holds(since) for t in tests)
                fired.append(hit)
                since = 0 if hit else since
            yield batch.filter(pa.array(fired))

    dealt = d.repartition(*stream) if stream else d.repartition(1)
    dealt = dealt.sortWithinPartitions(*stream, *[k for k in keys if k not in stream], *[c for c in order if c not in keys])
    return dealt.mapInArrow(run, d.schema)


def apply_patterns(steps: DataFrame, configs: Sequence[PatternConfig], stream: Sequence[str], order: Sequence[str], episode: str | None = None, end: Column | None = None) -> DataFrame:
    """All configs of one output structure: each makes its items by itself; ``config_idx`` tells them apart.

    See :func:`apply_pattern`. One window holds the cells and conditions of all configs, so that steps are read, shuffled
    and sorted once, and each step's items are spread over rows. Configs with steps_since_applied read what the window
    gives once more, one pass each.
    """
    if not configs:
        raise ValueError("at least one config is needed")
    if len({tuple(sorted(c.nodes)) for c in configs}) > 1:
        raise ValueError("configs must have the same output columns")
    names = list(configs[0].nodes)
    keys = [*stream, *([episode] if episode else [])]
    window = Window.partitionBy(*keys).orderBy(*order)
    number = F.row_number().over(window)
    cells = {node: f"_n{i}" for i, node in enumerate(dict.fromkeys(n for c in configs for n in c.nodes.values()))}
    roots = [c for c in dict.fromkeys(c.split(".")[0] for config in configs for c in config.used()) if c not in (*keys, *order)]
    flags, later = [], {}
    for i, config in enumerate(configs):
        passed, waiting = _passed(steps, config, number)
        evaluated = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in config.used()], F.lit(False))
        flags += [evaluated.alias(f"_evaluated{i}"), passed.alias(f"_passed{i}")]
        if waiting:
            later[i] = waiting
    d = steps.select(*keys, *order, *roots, F.coalesce(end if end is not None else F.lit(False), F.lit(False)).alias("_end"))
    d = d.select(*keys, *order, *[_cell(node, window).alias(k) for node, k in cells.items()], *flags)

    def ready(i: int) -> Column:
        found = F.col(f"_evaluated{i}") & F.col(f"_passed{i}")
        for node in configs[i].nodes.values():
            found = found & F.col(cells[node]).isNotNull()
        return found

    made = []
    now = [i for i in range(len(configs)) if i not in later]
    if len(now) == 1:
        made.append(d.where(ready(now[0])).select(*keys, *order, _item(configs[now[0]], now[0], cells).alias("_item")))
    elif now:
        each = F.array_compact(F.array(*[F.when(ready(i), _item(configs[i], i, cells)) for i in now]))
        made.append(d.select(*keys, *order, F.explode(each).alias("_item")))
    for i, tests in later.items():
        own = d.where(f"_evaluated{i}").select(*keys, *order, *cells.values(), ready(i).alias("_ready"))
        made.append(_since_applied(own, tests, list(stream), keys, list(order)).select(*keys, *order, _item(configs[i], i, cells).alias("_item")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    columns = [F.col("_item._columns").getField(name).alias(name) for name in names]
    return out.select(*keys, *order, "_item.table", "_item.priority", *columns, "_item.config_idx")


def with_info(items: DataFrame) -> DataFrame:
    """Adds an ``info`` struct of zeros, as a sampled row has it."""
    return items.withColumn("info", F.struct(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("table_size"), F.lit(0.0).alias("priority"), F.lit(0).alias("times_sampled")))
