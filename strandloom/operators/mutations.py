"""Changes of tables of items, and their counters: inserts, updates, deletes, copies on first sample, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_assign(log: DataFrame, data: tuple[str, ...] = ()) -> DataFrame:
    """Items from a log of inserts: an existing key keeps its first data and takes the last priority.

    One partial aggregate on (table, key). ``update_seq`` is the last write's, ``insert_seq`` the first's.
    """
    first, last = F.min("op_seq"), F.max("op_seq")
    return log.groupBy("table", "key").agg(
        first.alias("insert_seq"), last.alias("update_seq"), F.max_by("priority", "op_seq").alias("priority"), *[F.min_by(c, "op_seq").alias(c) for c in data]
    )


def mutate_priorities(items: DataFrame, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Deletes, then updates; unknown keys are ignored, the last update of a key (by op_seq) counts, null priorities raise."""
    if deletes is not None:
        items = items.join(deletes.select("table", "key").distinct(), ["table", "key"], "left_anti")
    if updates is not None:
        p = F.col("priority")
        checked = F.when(p.isNull() | F.isnan(p) | (p < 0), F.raise_error(F.lit("priorities must not be negative, null or NaN"))).otherwise(p)
        last = updates.withColumn("priority", checked).groupBy("table", "key").agg(F.max_by("priority", "op_seq").alias("_p"), F.max("op_seq").alias("_s"))
        names = items.columns
        items = items.join(last, ["table", "key"], "left").withColumns({"priority": F.coalesce("_p", "priority"), "update_seq": F.coalesce("_s", "update_seq")}).select(*names)
    return items


def after_sampling(items: DataFrame, draws: DataFrame, max_times_sampled: int = 0) -> DataFrame:
    """Items with their times_sampled raised by the draws; those that reached the maximum (if positive) are deleted."""
    drawn = draws.groupBy("table", "key").agg(F.count("*").alias("_n"))
    names = items.columns
    out = items.join(drawn, ["table", "key"], "left").withColumn("times_sampled", (F.col("times_sampled") + F.coalesce("_n", F.lit(0))).cast("long")).select(*names)
    return out.where(F.col("times_sampled") < max_times_sampled) if max_times_sampled > 0 else out


def insert_on_sample(items: DataFrame, draws: DataFrame, target: str) -> DataFrame:
    """What the first sample of each item puts into table ``target``: the same item, sampled once."""
    first = draws.groupBy("table", "key").agg(F.min("op_seq").alias("insert_seq"))
    rest = items.drop("insert_seq", "update_seq").join(first, ["table", "key"])
    return rest.withColumns({"table": F.lit(target), "times_sampled": F.lit(1).cast("long"), "update_seq": F.col("insert_seq")})


def get_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items with these (table, key); unknown ones are ignored. Use ``limit`` for any n items."""
    return items.join(keys.select("table", "key").distinct(), ["table", "key"], "left_semi")


def episode_counts(refs: DataFrame) -> DataFrame:
    """(table, num_episodes): episodes that live items refer to. ``refs``: table, key, episode_id."""
    return refs.select("table", "episode_id").distinct().groupBy("table").agg(F.count("*").alias("num_episodes"))


def deleted_episode_counts(events: DataFrame) -> DataFrame:
    """(table, num_deleted_episodes): how often an episode's count of references fell back to 0.

    ``events``: table, episode_id, op_seq, delta (+1 or -1 for each distinct chunk of an inserted or deleted item).
    """
    w = Window.partitionBy("table", "episode_id").orderBy("op_seq")
    zero = events.groupBy("table", "episode_id", "op_seq").agg(F.sum("delta").alias("delta")).withColumn("refs", F.sum("delta").over(w)).where("refs = 0 AND delta < 0")
    return zero.groupBy("table").agg(F.count("*").alias("num_deleted_episodes"))


def table_info(items: DataFrame) -> DataFrame:
    """One row per table: current_size, num_unique_samples, total_samples, priorities; a partial aggregate."""
    return items.groupBy("table").agg(
        F.count("*").alias("current_size"), F.count(F.when(F.col("times_sampled") > 0, 1)).alias("num_unique_samples"),
        F.sum("times_sampled").alias("total_samples"), F.min("priority").alias("min_priority"), F.max("priority").alias("max_priority"),
    )


def invalid_items(items: DataFrame) -> DataFrame:
    """Items that break a rule: an empty trajectory, a NaN priority, or chunks listed that no slice reads (or the reverse)."""
    read = F.array_distinct(F.flatten(F.transform("columns", lambda c: F.transform(c["slices"], lambda s: s["chunk_key"]))))
    same = (F.size(F.array_except("chunk_keys", read)) == 0) & (F.size(F.array_except(read, F.col("chunk_keys"))) == 0)
    return items.where((F.size("columns") <= 0) | F.exists("columns", lambda c: F.size(c["slices"]) == 0) | F.isnan("priority") | ~same)
