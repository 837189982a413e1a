"""Operator 10: sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

Each shard owns ``vnodes`` arcs of a ring of 2^20 places. A row goes to the arc its key falls in; where the arc's
shard is full, the overflow continues clockwise to the next shard with room. Capacities are bounded: with ``slack`` 0
the first ``total mod n`` shards take ceil(total / n) rows and the others floor(total / n), so that counts are at most
one apart whatever the keys; with more slack fewer rows move and counts stay below (1 + slack) total / n + 1.

Which rows of an arc overflow depends on counts alone, so the ring is solved on one row per arc (a number fixed by
``n_shards`` and ``vnodes``), and rows find their part by their rank in the arc. Ranks come from cells, ``cells`` to
an arc, over which equal keys are spread too: a key that holds a third of all rows makes no large cell.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

PLACES = 1 << 20


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. A node's place depends on the shard's own number alone."""
    place = lambda s, v: int.from_bytes(blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") % PLACES
    return sorted({place(s, v): s for s in range(n_shards) for v in range(vnodes)}.items())


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [int((1 + slack) * total / n_shards) + 1] * n_shards


def flow(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Parts (arc, from, to, shard, first slot) that place each arc's ranks.

    First every arc fills its own shard, then what is left goes on clockwise, arc by arc, to the next shard with room.
    At most two parts for each arc and one for each time that a shard gets full.
    """
    free, used, parts, over = list(room), [0] * len(room), [], {}

    def place(arc: int, start: int, n: int, shard: int) -> int:
        take = min(n, free[shard])
        if take:
            parts.append((arc, start, start + take, shard, used[shard]))
            free[shard] -= take
            used[shard] += take
        return take

    for arc, shard in enumerate(owners):
        if n := counts.get(arc, 0):
            done = place(arc, 0, n, shard)
            if done < n:
                over[arc] = done
    for arc, done in over.items():
        step = 1
        while done < counts[arc]:
            done += place(arc, done, counts[arc] - done, owners[(arc + step) % len(owners)])
            step += 1
    return parts


def shard(docs: DataFrame, n_shards: int = 16, vnodes: int = 256, slack: float = 0.0, cells: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, arc, shard, slot (gapless from 0 in each shard).

    Nulls: a null text has size 1 and the checksum of no bytes; rows with a null doc_id are keyed by their text.
    Repeated rows are placed one by one (their order in the ring is that of the written key table). Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    arc_of = [bisect_left(places, p) for p in range(0, PLACES, PLACES >> 12)]
    data = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    place = F.pmod(F.coalesce(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)), F.lit(PLACES)).cast("int")
    keys = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), place.alias("place"))
    # The table of keys is written once: from here on every task sees the same rows in the same order.
    keys = cut(keys.withColumn("cell", F.pmod(F.xxhash64(F.lit(7), "doc_id", F.monotonically_increasing_id()), F.lit(cells)).cast("int")), "shard-keys")
    # Arc of a place: the first node at or after it. A step table narrows the search to a few nodes.
    near, nodes_ = F.lit(arc_of), F.lit(places)
    first = F.get(near, F.shiftright(F.col("place"), 8))
    ahead = F.filter(F.sequence(F.lit(0), F.lit(_most_in_step(places))), lambda i: F.coalesce(F.get(nodes_, first + i) >= F.col("place"), F.lit(True)))
    keys = keys.withColumn("arc", F.pmod(first + F.element_at(ahead, 1), F.lit(len(places))).cast("int"))
    counts = keys.groupBy("arc", "cell").count()
    by_cell = cut(counts.withColumn("before", F.sum("count").over(Window.partitionBy("arc").orderBy("cell")) - F.col("count")), "shard-cells")
    totals = {r["arc"]: r["n"] for r in by_cell.groupBy("arc").agg(F.sum("count").alias("n")).collect()}  # at most n_shards * vnodes rows
    parts = flow(totals, owners, capacities(sum(totals.values()), n_shards, slack))
    table = spark.createDataFrame(parts, "arc int, lo long, hi long, shard int, slot0 long")
    in_cell = by_cell.withColumn("end", F.col("before") + F.col("count")).join(F.broadcast(table), "arc").where((F.col("lo") < F.col("end")) & (F.col("hi") > F.col("before")))
    plan = in_cell.groupBy("arc", "cell").agg(F.first("before").alias("before"), F.collect_list(F.struct("lo", "hi", "shard", "slot0")).alias("parts"))
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "text_crc32", "size")) - 1)
    at = F.col("before") + F.col("rank")
    part = F.element_at(F.filter("parts", lambda x: (x["lo"] <= at) & (at < x["hi"])), 1)
    # The plan has at most n_shards * vnodes * cells rows, a number fixed by parameters.
    placed = ranked.join(F.broadcast(plan), ["arc", "cell"]).withColumn("part", part)
    return placed.select("doc_id", "size", "text_crc32", "arc", F.col("part.shard").alias("shard"), (F.col("part.slot0") + at - F.col("part.lo")).cast("long").alias("slot"))


def _most_in_step(places: list[int]) -> int:
    """The most nodes within one step of the step table, which bounds how far an arc lies from the table's entry."""
    counts: dict[int, int] = {}
    for p in places:
        counts[p >> 8] = counts.get(p >> 8, 0) + 1
    return max(counts.values())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law ``rows``: with slack 0 the sixteen counts are at most one apart."""
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
