"""The catalogue: each operator on the test tables as a query, and the same in DuckDB's SQL.

Steps are the events of a user in order of time, episodes end at events of type ``error``. Items are orders: the key
is the order's, the table its priority class, the item's priority its price in cents. Values are whole numbers where
sums could round, and arrays are spread over columns, so that both engines give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.operators import chunks as C
from strandloom.operators import limiter as L
from strandloom.operators import mutations as M
from strandloom.operators import selectors as K
from strandloom.operators import trajectory as TR
from strandloom.operators.patterns import Condition, apply_pattern, apply_patterns, create_config, create_reference_step, td_error
from strandloom.plans.replay import Server, Table
from strandloom.sources import steps as S
from strandloom.sources.checkpoint import Checkpointer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, v (value in cents), kind, is_last, ts."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("is_last"))


ORDER = ("ts", "event_id")
REF = create_reference_step()
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
STEPS_SQL = f"""steps AS (
  SELECT user_id, ts, event_id, round(value * 100)::BIGINT AS v, event_type AS kind, event_type = 'error' AS is_last,
         row_number() {W} - 1 AS step FROM events)"""
EPISODES_SQL = STEPS_SQL + """, episodes AS (
  SELECT *, coalesce(sum(is_last::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode FROM steps)"""


def pattern(spark: SparkSession, sf_dir: str, nodes: dict, conditions: tuple = (), **more) -> DataFrame:  # noqa: ANN003
    return apply_pattern(steps(spark, sf_dir), create_config(nodes, "t", conditions), ["user_id"], ORDER, **more)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("table"), F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").cast("double").alias("priority"), F.col("o_orderkey").alias("insert_seq"), F.col("o_orderkey").alias("update_seq"), F.lit(0).cast("long").alias("times_sampled"))


ITEMS_SQL = 'items AS (SELECT o_orderpriority AS "table", o_orderkey AS key, round(o_totalprice * 100)::BIGINT AS priority FROM orders)'

# ---- patterns


@query(f"WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, lag(v) {W} AS prev, v AS cur FROM steps) SELECT * FROM l WHERE prev IS NOT NULL AND cur IS NOT NULL")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern(spark, sf_dir, {"prev": REF["v"][-2], "cur": REF["v"][-1]}).select("user_id", "event_id", "prev", "cur")


@query(f"WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, lag(v, 2) {W} AS a, lag(v, 1) {W} AS b, v AS c FROM steps) SELECT * FROM l WHERE a + b + c IS NOT NULL")
def nstep_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern(spark, sf_dir, {"x": REF["v"][-3:]}).select("user_id", "event_id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(f"WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, lag(v, 4) {W} AS a, lag(v, 2) {W} AS b, v AS c FROM steps, (SELECT 1)) SELECT * FROM l WHERE a + b + c IS NOT NULL")
def strided_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern(spark, sf_dir, {"x": REF["v"][-5::2]}).select("user_id", "event_id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(f"""WITH {STEPS_SQL}, n AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN v END AS x FROM steps),
l AS (SELECT user_id, event_id, lag(x, 2) {W} AS a, lag(x, 1) {W} AS b, x AS c FROM n) SELECT * FROM l WHERE a + b + c IS NOT NULL""")
def null_skipping_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("v")))
    return apply_pattern(s, create_config({"x": REF["x"][-3:]}, "t"), ["user_id"], ORDER).select("user_id", "event_id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(f"""WITH {STEPS_SQL} SELECT test, user_id, event_id, v AS x FROM steps, (VALUES ('eq'), ('ge'), ('lt'), ('mod'), ('ne')) AS t(test)
WHERE v IS NOT NULL AND CASE test WHEN 'eq' THEN step = 3 WHEN 'ge' THEN step >= 5 WHEN 'lt' THEN step < 4 WHEN 'mod' THEN step % 3 = 1 ELSE step % 3 <> 0 END""")
def cond_step_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"eq": Condition.step_index() == 3, "ge": Condition.step_index() >= 5, "lt": Condition.step_index() < 4, "mod": Condition.step_index() % 3 == 1, "ne": Condition.step_index() % 3 != 0}
    configs = [create_config({"x": REF["v"][-1]}, name, (test,)) for name, test in tests.items()]
    return apply_patterns(steps(spark, sf_dir), configs, ["user_id"], ORDER).select(F.col("table").alias("test"), "user_id", "event_id", "x")


@query(f"WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, lag(v) {W} AS a, v AS b, kind FROM steps) SELECT user_id, event_id, a, b FROM l WHERE kind = 'click' AND a + b IS NOT NULL")
def cond_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("flag", F.col("kind") == "click")
    config = create_config({"a": REF["v"][-2], "b": REF["v"][-1]}, "t", (Condition.data("flag") == 1,))
    return apply_pattern(s, config, ["user_id"], ORDER).select("user_id", "event_id", "a", "b")


@query(f"WITH {EPISODES_SQL}, l AS (SELECT user_id, event_id, is_last, lag(v) OVER (PARTITION BY user_id, episode ORDER BY ts, event_id) AS a, v AS b FROM episodes) SELECT user_id, event_id, a, b FROM l WHERE is_last AND a + b IS NOT NULL")
def cond_end_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.number_episodes(steps(spark, sf_dir), ["user_id"], ORDER, F.col("is_last"))
    config = create_config({"a": REF["v"][-2], "b": REF["v"][-1]}, "t", (Condition.is_end_episode(),))
    return apply_pattern(s, config, ["user_id"], ORDER, "episode", F.col("is_last")).select("user_id", "event_id", "a", "b")


@query(f"""WITH RECURSIVE {STEPS_SQL}, n AS (SELECT *, row_number() {W} AS i FROM steps WHERE v IS NOT NULL),
r AS (
  SELECT user_id, i, event_id, v, step, CASE WHEN 1 >= 4 AND v % 2 = 0 THEN 1 ELSE 0 END AS fired, CASE WHEN 1 >= 4 AND v % 2 = 0 THEN 0 ELSE 1 END AS since FROM n WHERE i = 1
  UNION ALL
  SELECT n.user_id, n.i, n.event_id, n.v, n.step, CASE WHEN r.since + 1 >= 4 AND n.v % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN r.since + 1 >= 4 AND n.v % 2 = 0 THEN 0 ELSE r.since + 1 END
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT user_id, event_id, v AS x FROM r WHERE fired = 1""")
def steps_since_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("even", F.col("v") % 2 == 0)
    config = create_config({"x": REF["v"][-1]}, "t", (Condition.steps_since_applied() >= 4, Condition.data("even") == 1))
    return apply_pattern(s, config, ["user_id"], ORDER).select("user_id", "event_id", "x")


@query(f"""WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, step, lag(v) {W} AS a, v AS b FROM steps)
SELECT 'pairs' AS "table", 0 AS config_idx, user_id, event_id, a, b FROM l WHERE a + b IS NOT NULL
UNION ALL SELECT 'thirds', 1, user_id, event_id, a, b FROM l WHERE a + b IS NOT NULL AND step % 3 = 2""")
def multi_config_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = {"a": REF["v"][-2], "b": REF["v"][-1]}
    configs = [create_config(nodes, "pairs"), create_config(nodes, "thirds", (Condition.step_index() % 3 == 2,))]
    return apply_patterns(steps(spark, sf_dir), configs, ["user_id"], ORDER).select("table", "config_idx", "user_id", "event_id", "a", "b")


@query(f"WITH {EPISODES_SQL}, l AS (SELECT user_id, event_id, lag(v) OVER (PARTITION BY user_id, episode ORDER BY ts, event_id) AS a, v AS b FROM episodes) SELECT * FROM l WHERE a + b IS NOT NULL")
def episode_bounded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.number_episodes(steps(spark, sf_dir), ["user_id"], ORDER, F.col("is_last"))
    return apply_pattern(s, create_config({"a": REF["v"][-2], "b": REF["v"][-1]}, "t"), ["user_id"], ORDER, "episode").select("user_id", "event_id", "a", "b")


@query(f"""WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, v, lag(v) {W} AS p, lag(v, 2) {W} AS q FROM steps)
SELECT user_id, event_id, round(0.5 * greatest(abs(v), abs(p), abs(q)) + 0.5 * (abs(v) + abs(p) + abs(q)) / 3, 3) AS priority FROM l WHERE v + p + q IS NOT NULL""")
def td_error_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = create_config({"x": REF["v"][-3:]}, "t", (), td_error(0.5, "v"))
    return apply_pattern(steps(spark, sf_dir), config, ["user_id"], ORDER).select("user_id", "event_id", F.round("priority", 3).alias("priority"))


# ---- steps and trajectories


@query("SELECT event_id, max(value_c) AS value_c, max(kind) AS kind FROM (SELECT event_id, round(value * 100)::BIGINT AS value_c, NULL AS kind FROM events UNION ALL SELECT event_id, NULL, event_type FROM events) GROUP BY 1")
def partial_step_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    parts = s.select("event_id", F.col("v").alias("value_c"), F.lit(None).cast("string").alias("kind")).union(s.select("event_id", F.lit(None).cast("long"), "kind"))
    return S.merge_partial_steps(parts, ["event_id"], ["value_c", "kind"])


@query("SELECT vec_id, (i - 1)::INT AS step, round(embedding[i]::DOUBLE * 10000)::BIGINT AS cell FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding)")
def append_sequence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.append_sequence(read(spark, sf_dir, "embeddings"), ["vec_id"], ["embedding"])
    return out.select("vec_id", "step", F.round(F.col("embedding").cast("double") * 10000).cast("long").alias("cell"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT) - 1)::INT AS t, l_linenumber AS line, l_quantity::BIGINT AS quantity FROM lineitem")
def timestep_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")).alias("s"))
    whole = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s")).select("l_orderkey", F.col("s.l_linenumber").alias("line"), F.col("s.q").alias("quantity"))
    return TR.explode_timesteps(whole, ["l_orderkey"], ["line", "quantity"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
SELECT conv_id, string_agg(n::VARCHAR, ',' ORDER BY turn) AS lengths FROM c WHERE idx >= 1 AND idx < 6 GROUP BY conv_id""")
def trajectory_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 1 to 5 of each conversation, read from chunks of two turns through slices."""
    turns = _turns(spark, sf_dir)
    chunks = C.build_chunks(turns, ["conv_id"], "turn", "n", 2)
    places = S.number_steps(turns, ["conv_id"], ["turn"]).withColumnRenamed("step", "at")
    cells = C.assign_chunks(turns, ["conv_id"], "turn", "n", 2).join(places.select("conv_id", "turn", "at"), ["conv_id", "turn"]).where("at >= 1 AND at < 6")
    refs = cells.join(chunks.select("conv_id", "chunk_no", "chunk_key"), ["conv_id", "chunk_no"])
    slices = C.merge_slices(refs, ["conv_id"], "turn")
    out = TR.assemble(slices, chunks.select("chunk_key", "data"), ["conv_id"])
    return out.select("conv_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("lengths"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)
SELECT conv_id, string_agg(n::VARCHAR, ',' ORDER BY turn) AS lengths, coalesce(string_agg(n::VARCHAR, ',' ORDER BY turn) FILTER (idx >= 1 AND idx < 6), '') AS slice FROM c GROUP BY conv_id""")
def trajectory_gather_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of each conversation, read from chunks of two turns, and beside them turns 1 to 5."""
    turns = _turns(spark, sf_dir)
    chunks = C.build_chunks(turns, ["conv_id"], "turn", "n", 2)
    cells = C.assign_chunks(turns, ["conv_id"], "turn", "n", 2)
    refs = cells.join(chunks.select("conv_id", "chunk_no", "chunk_key"), ["conv_id", "chunk_no"])
    out = TR.assemble(C.merge_slices(refs, ["conv_id"], "turn"), chunks.select("chunk_key", "data"), ["conv_id"])
    whole = F.transform("values", lambda x: x.cast("string"))
    return out.select("conv_id", F.array_join(whole, ",").alias("lengths"), F.array_join(A.py_slice(whole, 1, 6), ",").alias("slice"))


@query("""WITH c AS (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
  lead(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations)
SELECT conv_id, (idx // 2)::INT AS stack, n::BIGINT AS a, m::BIGINT AS b FROM c WHERE m IS NOT NULL AND idx % 2 = 0""")
def frame_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n"))).alias("s"))
    stacks = whole.select("conv_id", F.posexplode(A.frame_stack(F.col("s.n"), 2, 2)).alias("stack", "x"))
    return stacks.select("conv_id", "stack", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT conv_id, string_agg(n::VARCHAR, ',' ORDER BY turn) AS observations, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (i < k), '') AS actions FROM c GROUP BY conv_id""")
def complete_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TR.complete_episodes(_turns(spark, sf_dir).withColumn("a", F.col("turn")), "conv_id", "turn", "n", "a")
    return out.select("conv_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("observations", "actions")])


@query(f"""WITH {STEPS_SQL}, l AS (SELECT user_id, event_id, lag(v) {W} AS a, v AS b, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING) AS n FROM steps)
SELECT user_id, event_id, a, b FROM l WHERE n = 2""")
def last_steps_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.last_steps(steps(spark, sf_dir), ["user_id"], ORDER, ["v"], 2)
    return out.select("user_id", "event_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("""SELECT region.r_regionkey, t AS "table", p AS priority FROM region, (VALUES ('a', 1.0::DOUBLE), ('b', 0.5::DOUBLE)) AS x(t, p)""")
def insert_many_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.insert(read(spark, sf_dir, "region").select("r_regionkey"), {"a": 1.0, "b": 0.5})


# ---- chunks

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
LINES_SQL = f"lines AS (SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS step, l_quantity::BIGINT AS q FROM lineitem)"
CELLS_SQL = LINES_SQL + ", cells AS (SELECT episode, step, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS idx, q FROM lines WHERE q % 5 <> 0)"


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.number_steps(read(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER)
    return rows.select(F.col("l_orderkey").alias("episode"), F.col("step").cast("long").alias("step"), F.col("l_quantity").cast("long").alias("q"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lines(spark, sf_dir).withColumn("q", F.when(F.col("q") % 5 != 0, F.col("q")))


@query(f'WITH {CELLS_SQL} SELECT episode, (idx // 2)::BIGINT AS chunk_no, min(step) AS "start", max(step) AS "end", count(*) AS num_rows, max(step) - min(step) + 1 <> count(*) AS sparse, sum(q)::BIGINT AS total FROM cells GROUP BY 1, 2')
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.build_chunks(_lines(spark, sf_dir), ["episode"], "step", "q", 2)
    return made.select("episode", "chunk_no", "start", "end", "num_rows", "sparse", F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {LINES_SQL}, f AS (SELECT *, coalesce(sum((q % 3 = 0)::INT) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM lines),
c AS (SELECT episode, part, step, q, (row_number() OVER (PARTITION BY episode, part ORDER BY step) - 1) // 2 AS piece FROM f WHERE q % 5 <> 0)
SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY part, piece) - 1 AS chunk_no, min(step) AS "start", max(step) AS "end", count(*) AS num_rows FROM c GROUP BY episode, part, piece""")
def chunk_ranges_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two cells at most, all closed after lines whose quantity is a multiple of three."""
    lines = _all_lines(spark, sf_dir).withColumn("flush", F.col("q") % 3 == 0).withColumn("q", F.when(F.col("q") % 5 != 0, F.col("q")))
    return C.build_chunks(lines, ["episode"], "step", "q", 2, F.col("flush")).select("episode", "chunk_no", "start", "end", "num_rows")


@query(f"""WITH {CELLS_SQL}, p AS (SELECT episode, idx, idx // 3 AS chunk_no, idx % 3 AS o FROM cells WHERE q % 2 = 1),
n AS (SELECT *, CASE WHEN lag(chunk_no) OVER w = chunk_no AND lag(o) OVER w + 1 = o THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY episode ORDER BY idx)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY episode ORDER BY idx) - 1 AS slice_no FROM n)
SELECT episode, slice_no::BIGINT AS slice_no, min(o)::BIGINT AS "offset", count(*) AS length FROM r GROUP BY 1, 2""")
def slice_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.assign_chunks(_lines(spark, sf_dir), ["episode"], "step", "q", 3).where("q % 2 = 1")
    out = C.merge_slices(cells.withColumn("chunk_key", F.col("chunk_no")), ["episode"], "step")
    return out.select("episode", F.col("slice_no").cast("long").alias("slice_no"), F.col("offset").cast("long").alias("offset"), "length")


@query(f"""WITH {CELLS_SQL}, c AS (SELECT episode, idx // 2 AS chunk_no, count(*) AS n FROM cells GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY episode ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
s AS (SELECT episode, chunk_no::BIGINT AS chunk_no, greatest(0, 1 - before)::BIGINT AS "offset", (least(n, 4 - before) - greatest(0, 1 - before))::BIGINT AS length FROM b) SELECT * FROM s WHERE length > 0""")
def flat_slices_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.build_chunks(_lines(spark, sf_dir), ["episode"], "step", "q", 2)
    return C.timestep_slices(made, ["episode"], "chunk_no", 1, 3)


@query(f"WITH {LINES_SQL} SELECT episode, step, (q - coalesce(lag(q) OVER (PARTITION BY episode ORDER BY step), 0))::BIGINT AS q FROM lines")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_lines(spark, sf_dir)
    return C.delta_encode(rows, ["episode"], "step", "q")


@query(f"WITH {LINES_SQL} SELECT episode, step, q FROM lines")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delta_decode(delta_encode(spark, sf_dir), ["episode"], "step", "q")


REFS_SQL = "refs AS (SELECT l_orderkey AS key, l_partkey AS chunk_key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'))"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live items are the open orders."""
    live = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"))
    return _all_refs(spark, sf_dir).join(live, "key", "left_semi")


@query(f"WITH {REFS_SQL} SELECT chunk_key, count(DISTINCT key) AS num_items FROM refs GROUP BY 1")
def chunk_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reference_counts(_refs(spark, sf_dir))


@query(f"WITH {REFS_SQL} SELECT p_partkey AS chunk_key FROM part WHERE p_partkey IN (SELECT chunk_key FROM refs)")
def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.live_chunks(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_key")), _refs(spark, sf_dir))


@query(f"WITH {REFS_SQL} SELECT p_partkey AS chunk_key FROM part WHERE p_partkey NOT IN (SELECT chunk_key FROM refs)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.orphan_chunks(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_key")), _refs(spark, sf_dir))


ALL_REFS_SQL = "refs AS (SELECT l_orderkey AS key, l_partkey AS chunk_key FROM lineitem)"
HELD_REFS_SQL = "refs AS (SELECT l_orderkey AS key, l_partkey AS chunk_key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"


def _all_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("chunk_key"))


def _held_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live items are the orders of status F."""
    held = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return _all_refs(spark, sf_dir).join(held, "key", "left_semi")


@query(f"WITH {ALL_REFS_SQL} SELECT chunk_key, count(DISTINCT key) AS num_items FROM refs GROUP BY 1")
def chunk_refcount_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reference_counts(_all_refs(spark, sf_dir))


@query(f"WITH {HELD_REFS_SQL} SELECT p_partkey AS chunk_key FROM part WHERE p_partkey IN (SELECT chunk_key FROM refs)")
def live_chunks_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.live_chunks(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_key")), _held_refs(spark, sf_dir))


@query(f"WITH {HELD_REFS_SQL} SELECT p_partkey AS chunk_key FROM part WHERE p_partkey NOT IN (SELECT chunk_key FROM refs)")
def orphan_chunks_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.orphan_chunks(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_key")), _held_refs(spark, sf_dir))


@query('SELECT o_orderpriority AS "table", count(DISTINCT o_custkey) AS num_episodes FROM orders GROUP BY 1')
def num_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return M.episode_counts(o.select(F.col("o_orderpriority").alias("table"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("episode_id")))


@query("""WITH e AS (SELECT o_orderpriority AS "table", o_custkey AS episode_id, o_orderkey * 2 AS op_seq, 1 AS delta FROM orders
  UNION ALL SELECT o_orderpriority, o_custkey, o_orderkey * 2 + 400, -1 FROM orders WHERE o_orderkey % 3 > 0),
s AS (SELECT "table", episode_id, op_seq, sum(delta) AS d FROM e GROUP BY 1, 2, 3),
r AS (SELECT "table", d, sum(d) OVER (PARTITION BY "table", episode_id ORDER BY op_seq) AS refs FROM s) SELECT "table", count(*) AS num_deleted_episodes FROM r WHERE refs = 0 AND d < 0 GROUP BY 1""")
def num_deleted_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("table"), F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("k"))
    made = o.select("table", "episode_id", (F.col("k") * 2).alias("op_seq"), F.lit(1).alias("delta"))
    gone = o.where("k % 3 > 0").select("table", "episode_id", (F.col("k") * 2 + 400).alias("op_seq"), F.lit(-1).alias("delta"))
    return M.deleted_episode_counts(made.union(gone))


# ---- selectors


def _heads(kind: str, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.head(items(spark, sf_dir), K.Selector(kind), 5).select("table", "key", "rank")

    run.__name__ = f"{kind.replace('_', '')}_head"
    query(f'WITH {ITEMS_SQL}, r AS (SELECT "table", key, row_number() OVER (PARTITION BY "table" ORDER BY {order}) AS rank FROM items) SELECT "table", key, rank::INT AS rank FROM r WHERE rank <= 5')(run)


def _survivors(kind: str, order: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.survivors(items(spark, sf_dir), K.Selector(kind), 100).select("table", "key")

    run.__name__ = f"{kind.replace('_', '')}_eviction_survivors"
    query(f'WITH {ITEMS_SQL}, r AS (SELECT "table", key, row_number() OVER (PARTITION BY "table" ORDER BY {order}) AS rank FROM items) SELECT "table", key FROM r WHERE rank <= 100')(run)


for _kind, _head, _last in (("fifo", "key", "key DESC"), ("lifo", "key DESC", "key"), ("min_heap", "priority, key", "priority DESC, key DESC"), ("max_heap", "priority DESC, key", "priority, key DESC")):
    _heads(_kind, _head)
    _survivors(_kind, _last)


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT "table", key, row_number() OVER (PARTITION BY "table" ORDER BY priority // 1000000 DESC, key) AS rank FROM items)
SELECT "table", key, rank::INT AS rank FROM r WHERE rank <= 2000""")
def maxheap_head_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More items than Spark's group limit takes, with many ties: the ranks come from ranges."""
    tied = items(spark, sf_dir).withColumn("priority", F.floor(F.col("priority") / 1_000_000).cast("double"))
    return K.head(tied, K.MaxHeap(), 2000).select("table", "key", "rank")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT "table", key, row_number() OVER (PARTITION BY "table" ORDER BY key DESC) AS rank FROM items) SELECT "table", key FROM r WHERE rank <= 2000""")
def fifo_eviction_survivors_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.survivors(items(spark, sf_dir), K.Fifo(), 2000).select("table", "key")


@query(f'WITH {ITEMS_SQL} SELECT "table", key, round(1.0::DOUBLE / count(*) OVER (PARTITION BY "table"), 9) AS probability FROM items')
def uniform_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.probabilities(items(spark, sf_dir), K.Uniform()).select("table", "key", F.round("probability", 9).alias("probability"))


@query(f'WITH {ITEMS_SQL} SELECT "table", key, round(pow(priority, 0.8) / sum(pow(priority, 0.8)) OVER (PARTITION BY "table"), 9) AS probability FROM items')
def prioritized_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.probabilities(items(spark, sf_dir), K.Prioritized(0.8)).select("table", "key", F.round("probability", 9).alias("probability"))


@query(f"""WITH {ITEMS_SQL}, z AS (SELECT "table", key, CASE WHEN "table" = '1-URGENT' THEN 0 WHEN key % 2 = 0 THEN 0 ELSE 1 END AS w FROM items)
SELECT "table", key, round(CASE WHEN sum(w) OVER p > 0 THEN w::DOUBLE / sum(w) OVER p ELSE 1.0::DOUBLE / count(*) OVER p END, 9) AS probability FROM z WINDOW p AS (PARTITION BY "table")""")
def prioritized_zero_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority 0 has weight 0 even with exponent 0; a table of zeros is uniform."""
    zero = items(spark, sf_dir).withColumn("priority", F.when((F.col("table") == "1-URGENT") | (F.col("key") % 2 == 0), F.lit(0.0)).otherwise(F.col("priority")))
    return K.probabilities(zero, K.Prioritized(0.0)).select("table", "key", F.round("probability", 9).alias("probability"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT "table", key, count(*) OVER w AS n, pow(priority, 0.8) / sum(pow(priority, 0.8)) OVER w AS p FROM items WINDOW w AS (PARTITION BY "table"))
SELECT "table", key, round(pow(n * p, -0.4), 6) AS weight FROM p""")
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    sized = K.probabilities(i, K.Prioritized(0.8)).join(i.groupBy("table").agg(F.count("*").alias("table_size")), "table")
    return K.importance_weights(sized, 0.4).select("table", "key", F.round("weight", 6).alias("weight"))


@query("""SELECT t AS "table", draw, round(concat('0x', substr(md5('7:' || t || ':' || draw), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE, 12) AS u
FROM (SELECT DISTINCT o_orderpriority AS t FROM orders), range(100) r(draw)""")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.draws(items(spark, sf_dir).select("table").distinct(), 100, 7).select("table", "draw", F.round("u", 12).alias("u"))


def _draw_sql(weight: str, seed: int) -> str:
    """Draws by running sums over whole tables in the order of bucket and key: what the two levels of sums add up to."""
    return f"""WITH {ITEMS_SQL}, w AS (SELECT "table", key, {weight} AS w, concat('0x', substr(md5(key::VARCHAR), 1, 8))::UBIGINT % 1024 AS b FROM items),
o AS (SELECT "table", key, w, sum(w) OVER (PARTITION BY "table" ORDER BY b, key ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY "table") AS total, count(*) OVER (PARTITION BY "table") AS n FROM w),
d AS (SELECT t AS "table", draw, concat('0x', substr(md5('{seed}:' || t || ':' || draw), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT DISTINCT o_orderpriority AS t FROM orders), range(500) r(draw)),
a AS (SELECT d."table", draw, u * total AS pos FROM d JOIN (SELECT DISTINCT "table", total FROM o) t ON t."table" = d."table")
SELECT a."table", draw, o.key, round(o.w / o.total, 9) AS probability, o.n AS table_size FROM a ASOF JOIN o ON a."table" = o."table" AND a.pos < o.hi"""


@query(_draw_sql("CASE WHEN priority = 0 THEN 0 ELSE pow(priority, 0.8) END", 7))
def seeded_prioritized_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return K.sample(i, K.draws(i.select("table").distinct(), 500, 7), K.Prioritized(0.8)).withColumn("probability", F.round("probability", 9))


@query(_draw_sql("1.0::DOUBLE", 11))
def seeded_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return K.sample(i, K.draws(i.select("table").distinct(), 500, 11), K.Uniform()).withColumn("probability", F.round("probability", 9))


# ---- rate limits and mutations

OPS_SQL = "ops AS (SELECT user_id AS \"table\", event_id AS op_seq, CASE WHEN event_type IN ('click', 'view') THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'sample' END AS op FROM events)"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("click", "view"), "insert").when(F.col("event_type") == "error", "delete").otherwise("sample")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("table"), F.col("event_id").alias("op_seq"), op.alias("op"), F.col("event_id").alias("key"))


ADMIT_SQL = f"""{OPS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY op_seq) AS i FROM ops),
r AS (
  SELECT "table", 0::BIGINT AS i, -1::BIGINT AS op_seq, '' AS op, 0 AS ins, 0 AS sam, 0 AS del, FALSE AS ok FROM ops GROUP BY "table"
  UNION ALL
  SELECT "table", i, op_seq, op, ins + (op = 'insert' AND ok)::INT, sam + (op = 'sample' AND ok)::INT, del + (op = 'delete')::INT, ok FROM (
    SELECT n."table", n.i, n.op_seq, n.op, r.ins, r.sam, r.del, CASE n.op
      WHEN 'insert' THEN r.ins + 1 - r.del <= 2 OR (r.ins + 1) * 1.5 - r.sam <= 3
      WHEN 'sample' THEN r.ins - r.del >= 2 AND r.ins * 1.5 - r.sam - 1 >= -1 ELSE TRUE END AS ok
    FROM r JOIN n ON n."table" = r."table" AND n.i = r.i + 1))"""


@query(f'WITH RECURSIVE {ADMIT_SQL} SELECT "table", op_seq, op, ok AS admitted FROM r WHERE i > 0')
def limiter_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.admit(_ops(spark, sf_dir).drop("key"), L.RateLimiter(1.5, 2, -1.0, 3.0))


@query(f"""WITH RECURSIVE {ADMIT_SQL}, c AS (SELECT "table", max(ins)::BIGINT AS inserts, max(sam)::BIGINT AS samples, max(del)::BIGINT AS deletes FROM r GROUP BY 1)
SELECT *, inserts - deletes >= 2 AND inserts * 1.5 - samples - 1 >= -1 AS can_sample, inserts + 1 - deletes <= 2 OR (inserts + 1) * 1.5 - samples <= 3 AS can_insert FROM c""")
def limiter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limiter allows after the operations that it has admitted."""
    limit = L.RateLimiter(1.5, 2, -1.0, 3.0)
    return L.limiter_state(L.admit(_ops(spark, sf_dir).drop("key"), limit).where("admitted"), limit)


def _held_sql(taken: str, left: str) -> str:
    """Five places that are filled and emptied one operation after the other, as a list."""
    return f"""WITH RECURSIVE {OPS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY op_seq) AS i FROM ops WHERE op <> 'delete'),
r AS (
  SELECT "table", 0::BIGINT AS i, -1::BIGINT AS op_seq, []::BIGINT[] AS held, NULL::BIGINT AS key FROM ops GROUP BY "table"
  UNION ALL
  SELECT n."table", n.i, n.op_seq, CASE WHEN n.op = 'insert' THEN CASE WHEN len(held) < 5 THEN list_append(held, n.op_seq) ELSE held END WHEN len(held) > 0 THEN {left} ELSE held END,
    CASE WHEN n.op = 'sample' AND len(held) > 0 THEN {taken} END
  FROM r JOIN n ON n."table" = r."table" AND n.i = r.i + 1)
SELECT "table", key, op_seq AS sampled_at FROM r WHERE key IS NOT NULL"""


def _admitted(spark: SparkSession, sf_dir: str, limit: L.RateLimiter) -> DataFrame:
    return L.admit(_ops(spark, sf_dir).where("op <> 'delete'"), limit).where("admitted")


@query(_held_sql("held[1]", "held[2:]"))
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.queue_replay(_admitted(spark, sf_dir, L.Queue(5)))


@query(_held_sql("held[len(held)]", "held[:len(held) - 1]"))
def stack_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stack_replay(_admitted(spark, sf_dir, L.Stack(5)))


@query("""SELECT o_orderpriority AS "table", o_custkey AS key, min(o_orderkey) AS insert_seq, max(o_orderkey) AS update_seq,
  arg_max(round(o_totalprice * 100)::BIGINT, o_orderkey) AS priority, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2""")
def insert_or_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    log = o.select(F.col("o_orderpriority").alias("table"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("op_seq"), F.round(F.col("o_totalprice") * 100).cast("long").alias("priority"), F.col("o_orderstatus").alias("status"))
    return M.insert_or_assign(log, ("status",))


@query(f"""WITH {ITEMS_SQL} SELECT "table", key, CASE WHEN key % 4 = 1 THEN key ELSE priority END::BIGINT AS priority FROM items WHERE key % 5 <> 0""")
def mutate_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    updates = i.where("key % 4 = 1").select("table", "key", F.col("key").cast("double").alias("priority"), F.lit(1 << 40).alias("op_seq"))
    return M.mutate_priorities(i, updates, i.where("key % 5 = 0")).select("table", "key", F.col("priority").cast("long").alias("priority"))


DRAWS_SQL = "draws AS (SELECT l_orderkey AS key, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R')"


def _draw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("table"))
    log = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op_seq"))
    return log.join(names, "key")


@query(f"""WITH {ITEMS_SQL}, {DRAWS_SQL}, c AS (SELECT key, count(*) AS n FROM draws GROUP BY key)
SELECT "table", items.key, coalesce(n, 0)::BIGINT AS times_sampled FROM items LEFT JOIN c ON c.key = items.key WHERE coalesce(n, 0) < 2""")
def max_times_sampled_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.after_sampling(items(spark, sf_dir), _draw_log(spark, sf_dir), 2).select("table", "key", "times_sampled")


@query(f"""WITH {ITEMS_SQL}, {DRAWS_SQL} SELECT 'seen' AS "table", items.key, items.priority::BIGINT AS priority, 1::BIGINT AS times_sampled, min(draws.key * 10 + n)::BIGINT AS insert_seq FROM items JOIN draws USING (key) GROUP BY ALL""")
def insert_on_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.insert_on_sample(items(spark, sf_dir), _draw_log(spark, sf_dir), "seen")
    return out.select("table", "key", F.col("priority").cast("long").alias("priority"), "times_sampled", "insert_seq")


@query(f"""WITH {ITEMS_SQL}, {DRAWS_SQL}, c AS (SELECT key, count(*) AS n FROM draws GROUP BY key), t AS (SELECT "table", priority, coalesce(n, 0) AS n FROM items LEFT JOIN c USING (key))
SELECT "table", count(*) AS current_size, count(*) FILTER (n > 0) AS num_unique_samples, sum(n)::BIGINT AS total_samples, min(priority)::BIGINT AS min_priority, max(priority)::BIGINT AS max_priority FROM t GROUP BY 1""")
def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.table_info(M.after_sampling(items(spark, sf_dir), _draw_log(spark, sf_dir)))
    return out.select("table", "current_size", "num_unique_samples", "total_samples", *[F.col(c).cast("long").alias(c) for c in ("min_priority", "max_priority")])


@query(f"""WITH {ITEMS_SQL} SELECT "table", key, priority FROM items WHERE key IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def get_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of the items that a draw log names."""
    return M.get_items(items(spark, sf_dir), _draw_log(spark, sf_dir)).select("table", "key", F.col("priority").cast("long").alias("priority"))


# ---- flat trajectories: an order is an item of two columns, whose slices its lines list

SLICES_SQL = f"""lines AS (SELECT l_orderkey AS key, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS n, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS step FROM lineitem)"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, columns: parts and suppliers as chunks; an order whose first line was returned has its second column squeezed."""
    lines = S.number_steps(read(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER)
    row = F.struct("step", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_returnflag") == "R").alias("r"))
    whole = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(row)).alias("x"))

    def slices(chunk: str, index: int):  # noqa: ANN202
        return F.transform("x", lambda e: F.struct(e[chunk].alias("chunk_key"), F.when(e["step"] == 0, e["n"] % 3).otherwise(F.lit(0)).alias("offset"), e["n"].alias("length"), F.lit(index).alias("index")))

    columns = F.array(
        F.struct(F.lit(False).alias("squeeze"), slices("p", 0).alias("slices")), F.struct(F.get("x", F.lit(0))["r"].alias("squeeze"), slices("s", 1).alias("slices"))
    )
    return whole.select("key", columns.alias("columns"))


@query(f"""WITH {SLICES_SQL}, u AS (SELECT key, p AS k, step FROM lines UNION ALL SELECT key, s, 1000000 + step FROM lines), f AS (SELECT key, k, min(step) AS pos FROM u GROUP BY 1, 2)
SELECT key, string_agg(k::VARCHAR, ',' ORDER BY pos) AS chunk_keys FROM f GROUP BY key""")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("key", F.array_join(F.transform(A.chunk_keys(F.col("columns")), lambda k: k.cast("string")), ",").alias("chunk_keys"))


@query(f"""WITH {SLICES_SQL} SELECT key, sum(n)::BIGINT AS length, max(n % 3) FILTER (step = 0) AS "offset" FROM lines GROUP BY key""")
def trajectory_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("columns", F.lit(0))["slices"]
    return _flat(spark, sf_dir).select("key", A.column_length(first).alias("length"), A.column_offset(first).cast("long").alias("offset"))


@query(f"""WITH {SLICES_SQL} SELECT key, bool_and(p = s) AND NOT bool_or(flag = 'R' AND step = 0) AS is_timestep FROM lines GROUP BY key""")
def timestep_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("key", A.is_timestep_trajectory(F.col("columns")).alias("is_timestep"))


@query(f"""WITH {SLICES_SQL} SELECT key, NOT bool_or(flag = 'R' AND step = 0) AS is_timestep FROM lines GROUP BY key""")
def timestep_trajectories_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both columns read the chunks of the first; a squeezed column is no sequence of steps."""
    c = F.col("columns")
    same = F.transform(F.get(c, F.lit(0))["slices"], lambda s: s.withField("index", F.lit(1)))
    both = F.array(F.get(c, F.lit(0)), F.struct(F.get(c, F.lit(1))["squeeze"].alias("squeeze"), same.alias("slices")))
    return _flat(spark, sf_dir).select("key", A.is_timestep_trajectory(both).alias("is_timestep"))


@query(f"""WITH {SLICES_SQL} SELECT key FROM lines GROUP BY key HAVING bool_or(p <> s)""")
def invalid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are said to hold the first column's chunks only: wrong wherever the second reads another."""
    said = F.array_distinct(F.transform(F.get("columns", F.lit(0))["slices"], lambda s: s["chunk_key"]))
    return M.invalid_items(_flat(spark, sf_dir).withColumns({"chunk_keys": said, "priority": F.lit(1.0)})).select("key")


@query(f"""WITH {CELLS_SQL}, c AS (SELECT episode, idx // 2 AS chunk_no, count(*) AS n, arg_max(q, idx) AS second FROM cells GROUP BY 1, 2)
SELECT episode, chunk_no::BIGINT AS chunk_no, second AS cell, 16::BIGINT AS uncompressed_bytes FROM c WHERE n = 2""")
def unpack_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second cell of every full chunk, and the chunk's size of two 8-byte cells."""
    full = C.uncompressed_bytes(C.build_chunks(_lines(spark, sf_dir), ["episode"], "step", "q", 2), 8).where("num_rows = 2")
    return TR.unpack_column(full, 1, 1).select("episode", "chunk_no", A.squeeze(F.col("data")).alias("cell"), "uncompressed_bytes")


@query(f"""WITH {CELLS_SQL} SELECT episode, idx::BIGINT AS idx, (q - CASE WHEN idx % 3 = 0 THEN 0 ELSE lag(q, 1, 0) OVER (PARTITION BY episode ORDER BY idx) END)::BIGINT AS cell FROM cells""")
def delta_encode_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.build_chunks(_lines(spark, sf_dir), ["episode"], "step", "q", 3)
    cells = made.select("episode", "chunk_no", F.posexplode(C.delta_encode_array(F.col("data"))).alias("at", "cell"))
    return cells.select("episode", (F.col("chunk_no") * 3 + F.col("at")).alias("idx"), "cell")


@query("""SELECT o_orderkey AS key, o_custkey AS who, round(o_totalprice * 100)::BIGINT AS price, o_orderstatus AS status FROM orders""")
def unflatten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat columns to a nested record, and read from it."""
    o = read(spark, sf_dir, "orders")
    flat = o.select("o_orderkey", F.col("o_custkey").alias("order/who"), F.round(F.col("o_totalprice") * 100).cast("long").alias("order/state/price"), F.col("o_orderstatus").alias("order/state/status"))
    nested = TR.nest(flat, ["order/who", "order/state/price", "order/state/status"])
    return nested.select(F.col("o_orderkey").alias("key"), "order.who", "order.state.price", "order.state.status")


@query("""WITH c AS (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT conv_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY i) FILTER (i >= 1 AND i < k - 1 AND i % 2 = 1), '') AS middle, string_agg(n::VARCHAR, ',' ORDER BY i) FILTER (i >= k - 3) AS last,
  max(n) FILTER (i = k - 1)::BIGINT AS newest, max(n) FILTER (i = 0)::BIGINT AS oldest FROM c GROUP BY conv_id""")
def history_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one trajectory by different references into the history: strided, sliced, single and gathered cells."""
    whole = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n"))).alias("s"))
    h = F.col("s.n")
    text = lambda a: F.array_join(F.transform(A.require_cells(a), lambda x: x.cast("string")), ",")
    ends = A.require_cells(A.gather(h, [-1, 0]))
    return whole.select("conv_id", text(A.py_slice(h, 1, -1, 2)).alias("middle"), text(A.py_slice(h, -3, None)).alias("last"), A.squeeze(A.py_slice(h, -1, None)).alias("newest"), F.get(ends, F.lit(1)).alias("oldest"))


@query("SELECT conv_id, count(DISTINCT len(string_split(coalesce(text, ''), ' '))) = 1 AS uniform FROM conversations GROUP BY conv_id")
def uniform_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the turns of a conversation, each a cell of words, are all of one shape."""
    cells = read(spark, sf_dir, "conversations").select("conv_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    return cells.groupBy("conv_id").agg(F.collect_list("words").alias("c")).select("conv_id", A.same_shape(F.col("c")).alias("uniform"))


@query("""SELECT event_id, 1 AS missing FROM events WHERE event_type IN ('view', 'click')""")
def open_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks send only the first of their two parts."""
    s = steps(spark, sf_dir)
    parts = s.select("event_id", F.col("v").alias("value_c"), F.lit(None).cast("string").alias("kind")).union(s.where("kind NOT IN ('view', 'click')").select("event_id", F.lit(None).cast("long"), "kind"))
    return S.open_steps(parts, ["event_id"], ["value_c", "kind"])


@query(f"""WITH {EPISODES_SQL} SELECT user_id, event_id FROM (SELECT *, max((kind = 'signup')::INT) OVER (PARTITION BY user_id, episode ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lost FROM episodes) WHERE lost = 0""")
def usable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are taken for lost steps: the rest of their episode is of no use."""
    s = S.number_episodes(steps(spark, sf_dir), ["user_id"], ORDER, F.col("is_last"))
    return S.usable_steps(s, ["user_id"], "episode", ORDER, F.col("kind") == "signup").select("user_id", "event_id")


@query(f"""WITH {ITEMS_SQL} SELECT "table", key, priority FROM items""")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items saved to the shared folder and loaded from the latest complete checkpoint there."""
    saved = Checkpointer.temporary(spark)
    saved.save({"items": items(spark, sf_dir)}, {"seq": 1})
    return saved.load()[0]["items"].select("table", "key", F.col("priority").cast("long").alias("priority"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n FROM conversations),
w AS (SELECT conv_id, string_agg(n::VARCHAR, ',' ORDER BY turn) AS lengths, row_number() OVER (ORDER BY conv_id DESC) AS r FROM c GROUP BY conv_id)
SELECT 'all' AS "table", conv_id::BIGINT AS key, lengths FROM w UNION ALL SELECT 'recent', conv_id::BIGINT, lengths FROM w WHERE r <= 50""")
def chunked_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations over chunks of two turns, in a table of all and one of the last 50, which share the chunks: saved,
    restored in another server, and read from the restored chunks."""
    turns = _turns(spark, sf_dir)
    chunks = C.build_chunks(turns, ["conv_id"], "turn", "n", 2)
    refs = C.assign_chunks(turns, ["conv_id"], "turn", "n", 2).join(chunks.select("conv_id", "chunk_no", "chunk_key"), ["conv_id", "chunk_no"])
    part = F.struct("slice_no", "chunk_key", "offset", "length", F.lit(0).alias("index"))
    slices = C.merge_slices(refs, ["conv_id"], "turn").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("s"))
    made = slices.select(F.col("conv_id").cast("long").alias("key"), F.lit(1.0).alias("priority"), F.array_distinct("s.chunk_key").alias("chunk_keys"), F.array(F.struct(F.lit(False).alias("squeeze"), F.col("s").alias("slices"))).alias("columns"))
    tables = [Table(name, K.Uniform(), K.Fifo(), size, L.MinSize(1)) for name, size in (("all", 1 << 40), ("recent", 50))]
    server = Server(spark, tables, Checkpointer.temporary(spark))
    for t in tables:
        server.insert_trajectories(t.name, made, chunks)
    server.checkpoint()
    again = Server(spark, tables, server.checkpointer)
    out = None
    for t in tables:
        cells = again.cells(again.items(t.name), "key")
        own = cells.select(F.lit(t.name).alias("table"), "key", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("lengths"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT conv_id FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WHERE n <> 4")
def signature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("n").alias("n"))
    return TR.wrong_lengths(whole, {"n": 4}).select("conv_id")
