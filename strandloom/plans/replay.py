"""The replay store: tables of items with a sampler, a remover, sizes and a rate limit, over DataFrames.

A :class:`Server` holds a DataFrame of items per table, with their data columns, and one of the chunks that items over
chunks share; every call returns or replaces DataFrames and leaves their evaluation to Spark. :class:`Client` has the calls of users. Operations are applied in batches: a refused
batch raises :class:`Deferred`, which names the limit, and can be tried again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators import chunks as C
from strandloom.operators import limiter as L
from strandloom.operators import mutations, selectors
from strandloom.operators.patterns import PatternConfig, apply_patterns
from strandloom.operators.selectors import Selector
from strandloom.operators.trajectory import assemble, check_signature, explode_timesteps
from strandloom.sources.checkpoint import Checkpointer, shared_folder


class Deferred(RuntimeError):
    """The rate limit does not admit this operation now."""


class TableExtension:
    """Hooks of a table, to be overridden; each gets a DataFrame of the items concerned. Any callable of (event, items) will do too."""

    def on_insert(self, items: DataFrame) -> None: ...

    def on_delete(self, items: DataFrame) -> None: ...

    def on_update(self, items: DataFrame) -> None: ...

    def on_sample(self, items: DataFrame) -> None: ...

    def on_reset(self, items: DataFrame) -> None: ...

    def __call__(self, event: str, items: DataFrame) -> None:
        getattr(self, f"on_{event}")(items)


@dataclass(frozen=True)
class SampleOptions:
    """What a reader of samples asks for; -1 leaves a choice open."""

    max_samples: int = -1
    max_in_flight: int = 100
    num_workers: int = -1
    max_samples_per_stream: int = -1
    timeout_ms: int = -1

    def __post_init__(self) -> None:
        for name in ("max_samples", "num_workers", "max_samples_per_stream"):
            if getattr(self, name) != -1 and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive, or -1")
        if self.max_in_flight < 1:
            raise ValueError("max_in_flight must be positive")
        if self.timeout_ms < -1:
            raise ValueError("timeout_ms must not be negative, or must be -1")


@dataclass(frozen=True)
class Table:
    name: str
    sampler: Selector
    remover: Selector
    max_size: int
    rate_limiter: L.RateLimiter
    max_times_sampled: int = 0
    signature: T.StructType | None = None
    #: Called with (event, DataFrame of the items concerned) after inserts, samples, updates, deletes (evictions and items
    #: sampled for the last time too) and resets.
    extensions: tuple[Callable[[str, DataFrame], None], ...] = ()

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a table needs a name")
        if self.max_size < 1:
            raise ValueError("max_size must be positive")

    @staticmethod
    def queue(name: str, max_size: int, **more) -> Table:  # noqa: ANN003
        return Table(name, selectors.Fifo(), selectors.Fifo(), max_size, L.Queue(max_size), 1, **more)

    @staticmethod
    def stack(name: str, max_size: int, **more) -> Table:  # noqa: ANN003
        return Table(name, selectors.Lifo(), selectors.Lifo(), max_size, L.Stack(max_size), 1, **more)

    def replace(self, **changes) -> Table:  # noqa: ANN003
        return replace(self, **changes)


@dataclass
class _State:
    items: DataFrame | None = None
    inserts: int = 0
    samples: int = 0
    deletes: int = 0
    unique: int = 0


@dataclass
class Server:
    spark: SparkSession
    tables: Sequence[Table]
    checkpointer: Checkpointer | None = None
    _states: dict[str, _State] = field(default_factory=dict)
    _seq: int = 0
    _chunks: DataFrame | None = None

    def __post_init__(self) -> None:
        if not self.tables:
            raise ValueError("a server needs at least one table")
        if len({t.name for t in self.tables}) < len(self.tables):
            raise ValueError("table names must be unique")
        self._states = {t.name: _State() for t in self.tables}
        if self.checkpointer and self.checkpointer.latest():
            self.restore()

    @staticmethod
    def from_config(spark: SparkSession, config: Sequence[dict]) -> Server:
        """Tables from plain dicts, as a JSON file has them: selectors by kind, the limiter by its four numbers."""
        made = []
        for c in config:
            c = dict(c)
            limit = c.pop("rate_limiter")
            made.append(Table(sampler=Selector(**c.pop("sampler")), remover=Selector(**c.pop("remover")), rate_limiter=L.RateLimiter(**limit), **c))
        return Server(spark, made)

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name == name:
                return t
        raise KeyError(f"no table {name}; there are {[t.name for t in self.tables]}")

    def _tell(self, table: Table, event: str, rows: DataFrame) -> None:
        for call in table.extensions:
            call(event, rows)

    def _settle(self, df: DataFrame) -> DataFrame:
        """Items as they now are, cut from the plan that made them, in the checkpoint folder that the cluster shares."""
        shared_folder(self.spark)
        return df.checkpoint()

    def items(self, name: str) -> DataFrame | None:
        self.table(name)
        return self._states[name].items

    def can_insert(self, name: str, n: int = 1) -> bool:
        t, s = self.table(name), self._states[name]
        return bool(t.rate_limiter.can_insert(s.inserts, s.samples, s.deletes, n))

    def can_sample(self, name: str, n: int = 1) -> bool:
        t, s = self.table(name), self._states[name]
        return bool(t.rate_limiter.can_sample(s.inserts, s.samples, s.deletes, n))

    def insert(self, name: str, rows: DataFrame) -> int:
        """Inserts items (key, priority and data columns; ``op_seq`` orders them); existing keys get the new priority only.

        New items beyond ``max_size`` evict as the remover says. Returns the number of new items. A batch that overflows
        its table must be of new keys, each once: whether a key is new depends on what was evicted before it, so other
        batches are refused with a ValueError, to be split.
        """
        t, s = self.table(name), self._states[name]
        if t.signature is not None:
            check_signature(T.StructType([f for f in rows.schema.fields if f.name not in ("key", "priority", "op_seq", "table")]), t.signature)
        if not t.remover.deterministic:
            raise ValueError("batch inserts need a deterministic remover")
        order = "op_seq" if "op_seq" in rows.columns else "key"
        rows = selectors.check_priorities(rows.withColumn("op_seq", F.col(order).cast("long") + F.lit(self._seq)).withColumn("table", F.lit(name)))
        data = tuple(c for c in rows.columns if c not in ("table", "key", "priority", "op_seq"))
        made = self._settle(mutations.insert_or_assign(rows, data).withColumn("times_sampled", F.lit(0).cast("long")))
        if s.items is None:
            new, kept = made, made
        else:
            new = made.join(s.items.select("table", "key"), ["table", "key"], "left_anti")
            known = made.select("table", "key", "priority", F.col("update_seq").alias("op_seq"))
            kept = mutations.mutate_priorities(s.items, known).unionByName(new)
        n = new.count()
        if n and not bool(t.rate_limiter.can_insert(s.inserts, s.samples, s.deletes, n)):
            raise Deferred(f"table {name} does not admit {n} inserts now")
        before = 0 if s.items is None else s.items.count()
        if before + n > t.max_size and n < rows.count():
            raise ValueError(f"a batch that overflows table {name} must not write a key twice, nor one that the table has")
        left = self._settle(selectors.survivors(kept, t.remover, t.max_size))
        self._seq = max(self._seq, made.agg(F.max("update_seq")).first()[0] or 0) + 1
        gone = before + n - left.count()
        s.items, s.inserts = left, s.inserts + n
        s.deletes += gone
        self._tell(t, "insert", new)
        if gone:
            self._tell(t, "delete", kept.join(left.select("table", "key"), ["table", "key"], "left_anti"))
        return n

    def insert_trajectories(self, name: str, items: DataFrame, chunks: DataFrame) -> int:
        """Inserts items (key, priority, ``chunk_keys`` and ``columns`` of slices) over ``chunks`` (chunk_key, data).

        Tables share chunks: each is held once, as long as an item of any table reads it. Invalid items, and items of
        chunks that neither ``chunks`` nor the server has, raise a ValueError before anything changes.
        """
        items = self._settle(items)
        if mutations.invalid_items(items).limit(1).count():
            raise ValueError("an item is empty, has a NaN priority, or lists other chunks than its slices read")
        held = chunks.select("chunk_key", "data").dropDuplicates(["chunk_key"])
        if self._chunks is not None:
            held = self._chunks.unionByName(held.join(self._chunks.select("chunk_key"), "chunk_key", "left_anti"))
        held = self._settle(held)
        if items.select(F.explode("chunk_keys").alias("chunk_key")).join(held, "chunk_key", "left_anti").limit(1).count():
            raise ValueError("an item refers to a chunk that is missing")
        n = self.insert(name, items)
        self._chunks = held
        self._chunks = self._settle(self.chunks())
        return n

    def _references(self) -> DataFrame | None:
        out = None
        for name, s in self._states.items():
            if s.items is not None and "chunk_keys" in s.items.columns:
                own = s.items.select(F.lit(name).alias("table"), "key", F.explode("chunk_keys").alias("chunk_key"))
                out = own if out is None else out.unionByName(own)
        return out

    def chunks(self) -> DataFrame | None:
        """The chunks that items of any table read; None if there has never been one."""
        refs = self._references()
        if self._chunks is None or refs is None:
            return self._chunks if self._chunks is None else self._chunks.limit(0)
        return C.live_chunks(self._chunks, refs)

    def cells(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, column, values): the cells of items over chunks, of a table's ``items`` or of a sample (by ``draw``)."""
        columns = rows.select(key, F.posexplode("columns").alias("column", "_c"))
        slices = columns.select(key, "column", F.posexplode("_c.slices").alias("slice_no", "_s"))
        return assemble(slices.select(key, "column", "slice_no", "_s.chunk_key", "_s.offset", "_s.length"), self._chunks, [key, "column"])

    def sample(self, name: str, num_samples: int = 1, seed: int = 0) -> DataFrame:
        """``num_samples`` draws with replacement from the table as it is: draw, info, and the items' data.

        Deterministic samplers return their next items, each as often as ``max_times_sampled`` still allows; there are
        fewer draws only if the whole table has fewer uses left. Counters, times_sampled and deletions follow.
        """
        t, s = self.table(name), self._states[name]
        if num_samples < 1:
            raise ValueError("num_samples must be positive")
        if s.items is None or not self.can_sample(name, num_samples):
            raise Deferred(f"table {name} does not admit {num_samples} samples now")
        size = s.items.count()
        if t.sampler.deterministic:
            uses = F.lit(t.max_times_sampled) - F.col("times_sampled") if t.max_times_sampled > 0 else F.lit(num_samples)
            first = selectors.head(s.items.withColumn("_uses", uses.cast("long")).where("_uses > 0"), t.sampler, num_samples if t.max_times_sampled > 0 else 1)
            earlier = Window.partitionBy("table").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            first = first.withColumn("_before", F.coalesce(F.sum("_uses").over(earlier), F.lit(0).cast("long"))).where(F.col("_before") < num_samples)
            spread = first.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_uses", F.lit(num_samples) - F.col("_before")) - 1)))
            drawn = spread.select("table", (F.col("_before") + F.col("_i")).alias("draw"), "key", F.lit(1.0).alias("probability"), F.lit(size).cast("long").alias("table_size"))
        else:
            wanted = selectors.draws(self.spark.createDataFrame([(name,)], "table string"), num_samples, seed + s.samples)
            drawn = selectors.sample(s.items, wanted, t.sampler)
        drawn = self._settle(drawn.withColumn("op_seq", F.col("draw") + F.lit(self._seq)))
        nth = F.row_number().over(Window.partitionBy("table", "key").orderBy("draw"))
        info = F.struct("key", "probability", "table_size", "priority", (F.col("times_sampled") + F.col("_nth")).alias("times_sampled"))
        rows = drawn.withColumn("_nth", nth).join(s.items, ["table", "key"])
        data = [c for c in s.items.columns if c not in ("table", "key", "priority", "times_sampled", "insert_seq", "update_seq")]
        out = self._settle(rows.select("draw", info.alias("info"), *data))
        s.unique += drawn.select("key").distinct().join(s.items.where("times_sampled = 0").select("key"), "key", "left_semi").count()
        left = self._settle(mutations.after_sampling(s.items, drawn, t.max_times_sampled))
        n, gone, held = out.count(), size - left.count(), s.items
        self._seq += num_samples
        s.samples, s.deletes, s.items = s.samples + n, s.deletes + gone, left
        self._tell(t, "sample", out)
        if gone:
            self._tell(t, "delete", held.join(left.select("table", "key"), ["table", "key"], "left_anti"))
        return out

    def trajectories(self, name: str, num_samples: int = 1, seed: int = 0) -> DataFrame:
        """Samples as ``info`` and the columns that the table's signature declares, in its order."""
        signature = self.table(name).signature
        if signature is None:
            raise ValueError(f"table {name} declares no signature")
        return self.sample(name, num_samples, seed).select("info", *signature.fieldNames())

    def mutate(self, name: str, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Priorities (key, priority[, op_seq]) to set and keys to delete; deletes win, unknown keys are ignored."""
        t, s = self.table(name), self._states[name]
        if s.items is None:
            return
        if updates is not None:
            updates = updates.withColumn("op_seq", (F.col("op_seq") if "op_seq" in updates.columns else F.lit(0)).cast("long") + F.lit(self._seq)).withColumn("table", F.lit(name))
        left = self._settle(mutations.mutate_priorities(s.items, updates, deletes.withColumn("table", F.lit(name)) if deletes is not None else None))
        held, gone = s.items, s.items.count() - left.count()
        s.deletes += gone
        s.items, self._seq = left, self._seq + 1
        if updates is not None:
            self._tell(t, "update", left.join(updates.select("key").distinct(), "key", "left_semi"))
        if gone:
            self._tell(t, "delete", held.join(left.select("table", "key"), ["table", "key"], "left_anti"))

    def reset(self, name: str) -> None:
        t = self.table(name)
        if self._states[name].items is not None:
            self._tell(t, "reset", self._states[name].items)
        self._states[name] = _State()

    def info(self) -> DataFrame:
        """One row per table: its config, size and counters."""
        rows = []
        for t in self.tables:
            s = self._states[t.name]
            rows.append((t.name, t.max_size, t.max_times_sampled, t.sampler.kind, t.remover.kind, 0 if s.items is None else s.items.count(), s.inserts, s.samples, s.deletes, s.unique))
        return self.spark.createDataFrame(rows, "name string, max_size long, max_times_sampled long, sampler string, remover string, current_size long, inserts long, samples long, deletes long, num_unique_samples long")

    def checkpoint(self, keep_latest: int = 1) -> str:
        if self.checkpointer is None:
            raise ValueError("this server has no checkpointer")
        tables = {f"items-{n}": s.items for n, s in self._states.items() if s.items is not None}
        if self._chunks is not None:
            tables["chunks"] = self.chunks()
        meta = {"seq": self._seq, "tables": [{"name": t.name, "sampler": asdict(t.sampler), "remover": asdict(t.remover), "max_size": t.max_size, "max_times_sampled": t.max_times_sampled, "rate_limiter": asdict(t.rate_limiter), "signature": t.signature.json() if t.signature is not None else None, "counters": [s.inserts, s.samples, s.deletes, s.unique]} for t, s in ((t, self._states[t.name]) for t in self.tables)]}
        return self.checkpointer.save(tables, meta, keep_latest)

    def restore(self, folder: str | None = None) -> None:
        """Items, counters and table configs of the latest checkpoint; extensions stay those given here."""
        tables, meta = self.checkpointer.load(folder)
        own = {t.name: t.extensions for t in self.tables}
        made = []
        for m in meta["tables"]:
            signature = T.StructType.fromJson(json.loads(m["signature"])) if m["signature"] else None
            made.append(Table(m["name"], Selector(**m["sampler"]), Selector(**m["remover"]), m["max_size"], L.RateLimiter(**m["rate_limiter"]), m["max_times_sampled"], signature, own.get(m["name"], ())))
            found = tables.get(f"items-{m['name']}")
            if found is not None and found.groupBy("key").count().where("count > 1").limit(1).count():
                raise ValueError(f"the checkpoint has a key of table {m['name']} twice")
            self._states[m["name"]] = _State(tables.get(f"items-{m['name']}"), *m["counters"])
        self._chunks = tables.get("chunks")
        refs = self._references()
        if refs is not None and (self._chunks is None or refs.join(self._chunks, "chunk_key", "left_anti").limit(1).count()):
            raise ValueError("the checkpoint lacks a chunk that an item refers to")
        self.tables, self._seq = made, meta["seq"]


@dataclass
class Client:
    server: Server

    def insert(self, row: DataFrame, priorities: dict[str, float]) -> None:
        """Each row as an item of its own in every table named; keys are made from the row's place in time and its table."""
        if not priorities:
            raise ValueError("an insert needs at least one table")
        for table, priority in priorities.items():
            if not priority >= 0:
                raise ValueError("priorities must not be negative or NaN")
            at = F.lit(self.server._seq).cast("long") + F.monotonically_increasing_id()
            self.server.insert(table, row.select("*", at.alias("key"), F.lit(float(priority)).alias("priority")))

    def insert_into(self, row: DataFrame, tables: Sequence[str], priorities: Sequence[float]) -> None:
        """``insert`` with an item of priority ``priorities[i]`` in ``tables[i]``; nothing is written if they do not fit."""
        if isinstance(tables, str) or len(tables) != len(priorities):
            raise ValueError("tables and priorities must be sequences of equal length")
        for t in tables:
            self.server.table(t)
        if not all(p >= 0 for p in priorities):
            raise ValueError("priorities must not be negative or NaN")
        for t, p in zip(tables, priorities, strict=True):
            self.insert(row, {t: p})

    def update_priorities(self, table: str, keys: Sequence[int], priorities: Sequence[float]) -> None:
        """Sets ``priorities[i]`` for ``keys[i]``; unknown keys are ignored, the last priority of a repeated key counts."""
        if len(keys) != len(priorities):
            raise ValueError("keys and priorities must be equally long")
        self.mutate_priorities(table, dict(zip(keys, priorities, strict=True)))

    def _number(self, items: DataFrame, order: Sequence[str]) -> DataFrame:
        """Items with ``op_seq`` from 0 in this order, in place of the order's columns: a sort by ranges, and each range's offset."""
        placed = self.server._settle(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*order))
        part = F.shiftright("_at", 33)
        starts, n = [], 0
        for r in placed.groupBy(part.alias("_part")).count().orderBy("_part").collect():  # a row for each partition
            starts.append((r["_part"], n))
            n += r["count"]
        offsets = self.server.spark.createDataFrame(starts, "_part long, _start long")
        joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        return joined.withColumn("op_seq", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")

    def write_patterns(self, steps: DataFrame, configs: Sequence[PatternConfig], stream: Sequence[str], order: Sequence[str], episode: str | None = None, end=None) -> dict[str, int]:  # noqa: ANN001
        """Applies pattern configs to steps and inserts what they make; returns the number of new items per table.

        A table's items are one batch, in the order of ``order``, then of stream and config.
        """
        if not configs:
            raise ValueError("at least one config is needed")
        made: dict[str, int] = {}
        for table in dict.fromkeys(c.table for c in configs):
            mine = [i for i, c in enumerate(configs) if c.table == table]
            own = apply_patterns(steps, [configs[i] for i in mine], stream, order, episode, end)
            config = F.get(F.array(*[F.lit(i) for i in mine]), F.col("config_idx"))
            key = F.xxhash64(config, *stream, *order).bitwiseAND(F.lit((1 << 63) - 1))
            places = [F.col(c).alias(f"_o{k}") for k, c in enumerate([*order, *stream])]
            items = own.select(key.alias("key"), "priority", *places, config.alias("_config"), *configs[mine[0]].nodes)
            numbered = self._number(items, [*[f"_o{k}" for k in range(len(order) + len(stream))], "_config"])
            made[table] = self.server.insert(table, numbered)
        return made

    def sample(self, table: str, num_samples: int = 1, emit_timesteps: bool = False, columns: Sequence[str] = (), seed: int = 0) -> DataFrame:
        rows = self.server.sample(table, num_samples, seed)
        return explode_timesteps(rows, ["draw", "info"], list(columns)) if emit_timesteps else rows

    def mutate_priorities(self, table: str, updates: dict[int, float] | None = None, deletes: Sequence[int] = ()) -> None:
        spark = self.server.spark
        for p in (updates or {}).values():
            if not p >= 0:
                raise ValueError("priorities must not be negative or NaN")
        self.server.mutate(
            table,
            spark.createDataFrame(list((updates or {}).items()), "key long, priority double") if updates else None,
            spark.createDataFrame([(k,) for k in deletes], "key long") if deletes else None,
        )

    def reset(self, table: str) -> None:
        self.server.reset(table)

    def server_info(self) -> DataFrame:
        return self.server.info()

    def checkpoint(self) -> str:
        return self.server.checkpoint()


def copy_on_first_sample(server: Server, source: str, target: str) -> Callable[[str, DataFrame], None]:
    """An extension: items that are sampled for the first time are inserted into ``target``, as sampled once."""

    def call(event: str, rows: DataFrame) -> None:
        if event == "sample":
            first = rows.where("info.times_sampled = 1")
            data = [c for c in rows.columns if c not in ("draw", "info")]
            server.insert(target, first.select(F.col("info.key").alias("key"), F.col("info.priority").alias("priority"), F.col("draw").alias("op_seq"), *data))
            state = server._states[target]
            state.items = state.items.withColumn("times_sampled", F.greatest("times_sampled", F.lit(1).cast("long")))

    return call
