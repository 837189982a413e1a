"""Connected components of links by union-find: local forests in every task, then star rounds between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_hot, small_enough

#: Links that a task's union-find holds at a time; a task with more starts a new forest.
FOREST_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces links by the union-find forest that they span: every node linked to the least node of its tree."""
    parent: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.record_batch([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["u", "v"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        n += batch.num_rows
        if n > FOREST_LINKS:
            yield flush()
            n = 0
    yield flush()


def _settle(edges: DataFrame) -> DataFrame:
    """Links every node to the least of its smaller neighbours, and these to that one (small star).

    A forest has one link a node, so no node has more smaller neighbours here than there were forests.
    """
    forests = edges.mapInArrow(_forest, "u binary, v binary")
    below = forests.groupBy("u").agg(F.collect_set("v").alias("below")).withColumn("m", F.array_min("below"))
    others = F.filter("below", lambda x: x != F.col("m"))
    return cut(below.select(F.explode(F.concat(F.array("u"), others)).alias("u"), F.col("m").alias("v")), "small-star")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: binary), root being the component's least node.

    Each round contracts links to forests inside tasks and settles every node on its least smaller neighbour (small
    star); then links to a node that has smaller neighbours itself move on to the least of these (large star). It ends
    when every node is linked to its root only. Larger neighbours are never gathered: a hub's least neighbour is an
    aggregate, joined back to its links. On small tables a round costs what its shuffles and written tables cost, so it
    has few: two tables, and a join only with nodes that have neighbours on both sides.
    """
    edges = _settle(links.select("u", "v").where(F.col("u") != F.col("v")))
    for _ in range(max_rounds):
        # edges: u > v
        both = edges.select("u", "v", F.lit(0).alias("above")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1)))
        least = cut(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("above").alias("n")), "least")
        # In a forest of stars a node has one smaller neighbour and no other, or only larger ones.
        if not least.where((F.col("low") < F.col("u")) & (F.col("low") < F.col("high"))).limit(1).count():
            return least.select(F.col("u").alias("node"), F.least("u", "low").alias("root"))
        inner = least.where((F.col("low") < F.col("u")) & (F.col("n") > 0)).select(F.col("u").alias("v"), F.col("low").alias("m"), "n")
        near = small_enough(inner, 32)
        moved = join_hot(edges, inner, ["v"], "n", how="left") if near is inner else edges.join(near, "v", "left")
        edges = _settle(moved.select("u", F.coalesce("m", "v").alias("v")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
