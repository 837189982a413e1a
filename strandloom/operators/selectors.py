"""Selectors: which item a table samples or evicts next, with what probability, and draws from these distributions.

Items have ``table``, ``key``, ``priority``, ``insert_seq`` (order of insertion) and ``update_seq`` (order of the last
insertion or update, which settles ties of the heaps).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranges import by_ranges, running_sum
from strandloom.sources.checkpoint import shared_folder


@dataclass(frozen=True)
class Selector:
    """``kind``: fifo, lifo, min_heap, max_heap, uniform or prioritized (with its exponent)."""

    kind: str
    exponent: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in ("fifo", "lifo", "min_heap", "max_heap", "uniform", "prioritized"):
            raise ValueError(f"unknown selector {self.kind}")
        if self.kind == "prioritized" and not self.exponent >= 0:
            raise ValueError("the exponent must not be negative")

    @property
    def deterministic(self) -> bool:
        return self.kind not in ("uniform", "prioritized")

    def order(self) -> list[Column]:
        """The order in which items are selected."""
        return {
            "fifo": [F.asc("insert_seq")], "lifo": [F.desc("insert_seq")],
            "min_heap": [F.asc("priority"), F.asc("update_seq")], "max_heap": [F.desc("priority"), F.asc("update_seq")],
        }[self.kind]


Fifo, Lifo, MinHeap, MaxHeap, Uniform = (lambda k=k: Selector(k) for k in ("fifo", "lifo", "min_heap", "max_heap", "uniform"))


def Prioritized(exponent: float) -> Selector:  # noqa: N802
    return Selector("prioritized", exponent)


def check_priorities(items: DataFrame) -> DataFrame:
    """The items; NaN, null or negative priorities raise when they are read."""
    p = F.col("priority")
    bad = p.isNull() | F.isnan(p) | (p < 0)
    return items.withColumn("priority", F.when(bad, F.raise_error(F.lit("priorities must not be negative, null or NaN"))).otherwise(p))


#: Up to this rank Spark keeps only the first rows of each task before it sorts a table (its window group limit).
GROUP_LIMIT = 1000


def _first(items: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` items of every table in this order, with ``rank`` from 1.

    For more than GROUP_LIMIT items no task gets a whole table: all are sorted by ranges of (table, order) into the
    folder in ``spark.checkpoint.dir``, ranges are counted, and an item's rank is its place in its range after the ranges before it.
    """
    if k <= GROUP_LIMIT:
        return items.withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy(*order))).where(F.col("rank") <= k)
    placed = by_ranges(items, ["table"], order)
    ranked = running_sum(placed, ["table"], order, F.lit(1), "rank", below=k).withColumn("rank", F.col("rank").cast("int"))
    return ranked.where(F.col("rank") <= k).select(*items.columns, "rank")


def head(items: DataFrame, selector: Selector, k: int = 1) -> DataFrame:
    """The next ``k`` items of every table, with ``rank`` from 1."""
    return _first(items, selector.order(), k)


def survivors(items: DataFrame, remover: Selector, max_size: int) -> DataFrame:
    """What is left of tables that were only inserted into, in the order of insert_seq, and hold ``max_size`` items.

    When a table is over its size the remover's choice goes, and the new item may be it: FIFO leaves the last
    insertions, LIFO the first (every later one goes at once), the heaps the items that they would choose last.
    """
    if not remover.deterministic:
        raise ValueError("only deterministic removers have a closed form")
    last = {
        "fifo": [F.desc("insert_seq")], "lifo": [F.asc("insert_seq")],
        "min_heap": [F.desc("priority"), F.desc("update_seq")], "max_heap": [F.asc("priority"), F.desc("update_seq")],
    }[remover.kind]
    return _first(items, last, max_size).drop("rank")


def _weight(exponent: float) -> Column:
    return F.when(F.col("priority") == 0, F.lit(0.0)).otherwise(F.pow("priority", F.lit(float(exponent))))


def probabilities(items: DataFrame, selector: Selector) -> DataFrame:
    """Adds ``probability``. Totals are partial aggregates per table, joined back: no table is sorted or gathered."""
    if selector.kind == "uniform":
        totals = items.groupBy("table").agg(F.count("*").alias("_n"))
        return items.join(totals, "table").withColumn("probability", 1 / F.col("_n")).drop("_n")
    if selector.kind == "prioritized":
        totals = items.groupBy("table").agg(F.count("*").alias("_n"), F.sum(_weight(selector.exponent)).alias("_sum"))
        p = F.when(F.col("_sum") > 0, _weight(selector.exponent) / F.col("_sum")).otherwise(1 / F.col("_n"))
        return items.join(totals, "table").withColumn("probability", p).drop("_n", "_sum")
    return head(items, selector).drop("rank").withColumn("probability", F.lit(1.0))


def importance_weights(sampled: DataFrame, beta: float) -> DataFrame:
    """Adds ``weight`` = (table_size * probability) ^ -beta."""
    return sampled.withColumn("weight", F.pow(F.col("table_size") * F.col("probability"), F.lit(-float(beta))))


def bucket_of(key: Column, buckets: int) -> Column:
    """A bucket by 32 bits of the key's md5, which any engine can make."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def draws(tables: DataFrame, num_samples: int, seed: int) -> DataFrame:
    """(table, draw, u): ``num_samples`` uniform numbers in [0, 1) per table, the same in every run.

    52 bits of an md5 of seed, table and draw number: any engine can make the same numbers.
    """
    numbers = tables.select("table", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_samples - 1).cast("long"))).alias("draw"))
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("table"), F.col("draw").cast("string"))), 1, 13)
    return numbers.withColumn("u", F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52)))


def sample(items: DataFrame, wanted: DataFrame, selector: Selector, buckets: int = 1024, cell: int = 1024) -> DataFrame:
    """(table, draw, key, probability, table_size) for draws from uniform or prioritized tables, with replacement.

    Three-level inverse distribution: items are dealt over ``buckets`` key hashes a table, and in the order of their keys
    over cells of ``cell`` items; running sums are made inside each bucket and over the buckets. A draw finds its bucket
    and then its cell in short lists of their ends, and its item by an equi-join on the cell with a range condition, so
    it meets ``cell`` items at most. No table is sorted whole.
    """
    if selector.deterministic:
        chosen = head(items, selector).join(items.groupBy("table").agg(F.count("*").alias("table_size")), "table")
        return wanted.join(chosen, "table").select("table", "draw", "key", F.lit(1.0).alias("probability"), "table_size")
    weight = F.lit(1.0) if selector.kind == "uniform" else _weight(selector.exponent)
    rows = items.select("table", "key", weight.alias("w"), bucket_of(F.col("key"), buckets).alias("bucket"))
    totals = rows.groupBy("table").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    # A table whose weights are all zero is drawn from uniformly.
    rows = rows.join(totals, "table").withColumn("w", F.when(F.col("total") > 0, F.col("w")).otherwise(F.lit(1.0)))
    inside = Window.partitionBy("table", "bucket").orderBy("key")
    rows = rows.withColumns({"hi": F.sum("w").over(inside), "cell": F.floor((F.row_number().over(inside) - 1) / cell)}).withColumn("lo", F.coalesce(F.lag("hi").over(inside), F.lit(0.0)))
    shared_folder(items.sparkSession)
    rows = rows.checkpoint()  # read three times below: written once instead of sorted three times
    sums = rows.groupBy("table", "bucket").agg(F.max("hi").alias("s"))
    ends = sums.withColumn("end", F.sum("s").over(Window.partitionBy("table").orderBy("bucket")))
    lists = ends.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("end", "bucket", "s"))).alias("ends"))  # at most ``buckets`` entries
    at = F.col("u") * F.get("ends", F.size("ends") - 1)["end"]
    placed = wanted.join(lists, "table").withColumn("at", at)
    some = F.filter("ends", lambda e: e["s"] > 0)
    found = F.coalesce(F.get(F.filter(some, lambda e: e["end"] > F.col("at")), F.lit(0)), F.get(some, F.size(some) - 1))  # rounding: the last
    placed = placed.withColumn("e", found).select("table", "draw", F.col("e.bucket").alias("bucket"), F.least(F.col("at") - (F.col("e.end") - F.col("e.s")), F.col("e.s") * (1 - 1e-15)).alias("at"))
    cells = rows.groupBy("table", "bucket", "cell").agg(F.max("hi").alias("end"))
    cells = cells.groupBy("table", "bucket").agg(F.sort_array(F.collect_list(F.struct("cell", "end"))).alias("cells"))
    first = F.get(F.filter("cells", lambda c: c["end"] > F.col("at")), F.lit(0))["cell"]  # sums do not fall: the item is in it
    placed = placed.join(cells, ["table", "bucket"]).withColumn("cell", first).drop("cells")
    hit = placed.join(rows, ["table", "bucket", "cell"]).where((F.col("at") < F.col("hi")) & (F.greatest(F.col("at"), F.lit(0.0)) >= F.col("lo")) & (F.col("w") > 0))
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n"))
    return hit.select("table", "draw", "key", share.alias("probability"), F.col("n").alias("table_size"))
