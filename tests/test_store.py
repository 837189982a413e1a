import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import arrays as A
from strandloom.operators import chunks as C
from strandloom.operators import limiter as L
from strandloom.operators import mutations as M
from strandloom.operators import selectors as K
from strandloom.operators import trajectory as TR
from strandloom.operators.patterns import create_config, create_reference_step
from strandloom.operators.ranges import by_ranges, previous, running_sum
from strandloom.plans.replay import Client, Deferred, SampleOptions, Server, Table, TableExtension, copy_on_first_sample
from strandloom.sources.checkpoint import Checkpointer
from strandloom.streaming.patterns import admit_stream, apply_batches, sliding_stream


def frame(spark, rows):
    return spark.createDataFrame([(k, float(p)) for k, p in rows], "key long, priority double")


def test_chunks_round_trip(spark):
    rows = [(1, i, i * 10 if i != 3 else None) for i in range(7)]
    steps = spark.createDataFrame(rows, "ep int, step int, x int")
    made = C.build_chunks(steps, ["ep"], "step", "x", 2)
    got = [(r["start"], r["end"], r["num_rows"], r["sparse"], r["data"]) for r in made.orderBy("chunk_no").collect()]
    assert got == [(0, 1, 2, False, [0, 10]), (2, 4, 2, True, [20, 40]), (5, 6, 2, False, [50, 60])]
    refs = C.assign_chunks(steps, ["ep"], "step", "x", 2).where("step IN (0, 2, 4, 5)").join(made.select("ep", "chunk_no", "chunk_key"), ["ep", "chunk_no"])
    slices = C.merge_slices(refs, ["ep"], "step")
    assert TR.assemble(slices, made, ["ep"]).first()["values"] == [0, 20, 40, 50]
    with pytest.raises(Exception, match="missing"):
        TR.assemble(slices, made.where("chunk_no = 0"), ["ep"]).collect()
    back = C.delta_decode(C.delta_encode(steps.na.drop(), ["ep"], "step", "x"), ["ep"], "step", "x")
    assert sorted(r["x"] for r in back.collect()) == [0, 10, 20, 40, 50, 60]


def test_arrays(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>")
    x = F.col("x")
    row = d.select(A.gather(x, [0, -1, 9]).alias("g"), A.py_slice(x, -3, -1).alias("s"), A.py_slice(x, None, None, 2).alias("t"), A.frame_stack(x, 2, 2).alias("f"), A.frame_stack(x, 9).alias("n")).first()
    assert (row["g"], row["s"], row["t"], row["f"], row["n"]) == ([1, 5, None], [3, 4], [1, 3, 5], [[1, 2], [3, 4]], [])
    with pytest.raises(Exception, match="length 1"):
        d.select(A.squeeze(x)).collect()


def test_evictions_match_a_simulation(spark):
    r = random.Random(1)
    for kind in ("fifo", "lifo", "min_heap", "max_heap"):
        log = [(i, r.randrange(5)) for i in range(40)]
        held = []
        for k, p in log:
            held.append((k, p))
            if len(held) > 7:
                sign = {"min_heap": 1, "max_heap": -1}.get(kind)
                held.remove(min(held) if kind == "fifo" else max(held) if kind == "lifo" else min(held, key=lambda x: (sign * x[1], x[0])))
        items = spark.createDataFrame([("t", k, float(p), k, k) for k, p in log], "table string, key long, priority double, insert_seq long, update_seq long")
        assert sorted(x["key"] for x in K.survivors(items, K.Selector(kind), 7).collect()) == sorted(k for k, _ in held)


def test_ranks_of_large_tables_are_exact(spark):
    """Beyond GROUP_LIMIT the ranks come from ranges; tied priorities and two tables of unlike size."""
    r = random.Random(2)
    rows = [("a" if i % 7 else "b", i, float(r.randrange(3)), i, i) for i in range(9000)]
    items = spark.createDataFrame(rows, "table string, key long, priority double, insert_seq long, update_seq long").repartition(8)
    for kind, place in (("fifo", lambda x: x[3]), ("lifo", lambda x: -x[3]), ("min_heap", lambda x: (x[2], x[4])), ("max_heap", lambda x: (-x[2], x[4]))):
        want = [(t, x[1], n + 1) for t in "ab" for n, x in enumerate(sorted((x for x in rows if x[0] == t), key=place)[:2500])]
        assert sorted((x["table"], x["key"], x["rank"]) for x in K.head(items, K.Selector(kind), 2500).collect()) == sorted(want)
    assert sorted(x["key"] for x in K.survivors(items, K.Fifo(), 4000).where("table = 'a'").collect()) == sorted(x[1] for x in rows if x[0] == "a")[-4000:]
    assert K.head(items.limit(0), K.Fifo(), 2500).count() == 0


def test_sampling_follows_the_distribution(spark):
    items = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 3.0), ("t", 3, 0.0), ("z", 4, 0.0), ("z", 5, 0.0)], "table string, key long, priority double")
    wanted = K.draws(items.select("table").distinct(), 4000, 3)
    got = K.sample(items, wanted, K.Prioritized(1.0), buckets=8)
    n = {(r["table"], r["key"]): r["count"] for r in got.groupBy("table", "key").count().collect()}
    assert sum(n.values()) == 8000 and ("t", 3) not in n
    assert abs(n["t", 2] / 4000 - 0.75) < 0.03 and abs(n["z", 4] / 4000 - 0.5) < 0.03
    assert K.sample(items, wanted, K.Uniform()).where("table = 't'").select("key").distinct().count() == 3


def test_limiter(spark):
    limit = L.RateLimiter(1.5, 2, -1.0, 3.0)
    assert not limit.can_sample(1, 0, 0) and limit.can_sample(2, 0, 0) and limit.can_insert(2, 0, 0) is False
    ops = [(i, random.Random(i).choice(["insert", "insert", "sample", "delete"])) for i in range(60)]
    want, c = [], dict(insert=0, sample=0, delete=0)
    for _, op in ops:
        ok = limit.can_insert(*c.values()) if op == "insert" else limit.can_sample(*c.values()) if op == "sample" else True
        c[op] += bool(ok)
        want.append(bool(ok))
    df = spark.createDataFrame([("t", i, op) for i, op in ops], "table string, op_seq long, op string")
    assert [r["admitted"] for r in L.admit(df, limit).orderBy("op_seq").collect()] == want
    for bad in (lambda: L.MinSize(0), lambda: L.SampleToInsertRatio(0, 1, 5.0), lambda: L.SampleToInsertRatio(2.0, 1, 0.5), lambda: L.Queue(0)):
        with pytest.raises(ValueError):
            bad()
    assert L.SampleToInsertRatio(3.0, 3, 3.0).min_diff == 6.0


def test_stack_and_queue_replay(spark):
    r, held, stack, queue, ins = random.Random(4), [], [], [], []
    rows = []
    for i in range(80):
        op = r.choice(["insert", "sample"]) if held else "insert"
        rows.append(("t", i, op, i))
        if op == "insert":
            held.append(i)
            ins.append(i)
        else:
            stack.append((held.pop(), i))
            queue.append((ins.pop(0), i))
    df = spark.createDataFrame(rows, "table string, op_seq long, op string, key long")
    assert sorted((x["key"], x["sampled_at"]) for x in L.stack_replay(df).collect()) == sorted(stack)
    assert sorted((x["key"], x["sampled_at"]) for x in L.queue_replay(df).collect()) == sorted(queue)


def test_ranges(spark):
    """Sums, neighbours and replays of tables that fill many ranges, beside tables that share one."""
    r = random.Random(6)
    log = sorted({(t, i): r.choice(["insert", "insert", "sample"]) for t in "abbb" for i in r.sample(range(900), 200 if t == "b" else 20)}.items())
    df = spark.createDataFrame([(t, i, op, i) for (t, i), op in log], "table string, op_seq long, op string, key long").repartition(5)
    sums, before, held, line, stack, queue = {}, {}, {}, {}, [], []
    for (t, i), op in log:
        sums[t, i] = sum(x == "insert" for (u, j), x in log if u == t and j <= i)
        before[t, i] = max((j for (u, j), _ in log if u == t and j < i), default=None)
    admitted = []
    for (t, i), op in log:
        if op == "sample" and not held.get(t):
            continue
        admitted.append((t, i, op, i))
        if op == "insert":
            held.setdefault(t, []).append(i)
            line.setdefault(t, []).append(i)
        else:
            stack.append((t, held[t].pop(), i))
            queue.append((t, line[t].pop(0), i))
    kept = spark.createDataFrame(admitted, "table string, op_seq long, op string, key long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = by_ranges(df, ["table"], ["op_seq"])
        assert placed.where("table = 'b'").select("_part").distinct().count() > 1
        summed = running_sum(placed, ["table"], ["op_seq"], F.when(F.col("op") == "insert", 1).otherwise(0), "n")
        assert {(x["table"], x["op_seq"]): x["n"] for x in summed.collect()} == sums
        near = previous(placed, ["table"], ["op_seq"], ["op_seq"], "p").select("table", "op_seq", F.col("p.op_seq").alias("p"))
        assert {(x["table"], x["op_seq"]): x["p"] for x in near.collect()} == before
        for replay, want in ((L.stack_replay, stack), (L.queue_replay, queue)):
            assert sorted((x["table"], x["key"], x["sampled_at"]) for x in replay(kept).collect()) == sorted(want)
            assert replay(kept.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_store(spark, tmp_path):
    checkpoints = Checkpointer(spark, str(tmp_path / "c"))
    server = Server(spark, [Table("d", K.Prioritized(1.0), K.Fifo(), 3, L.MinSize(2)), Table.queue("q", 2), Table("seen", K.Uniform(), K.Fifo(), 10, L.MinSize(1))], checkpoints)
    client = Client(server)
    with pytest.raises(Deferred):
        client.sample("d")
    assert server.insert("d", frame(spark, [(1, 1), (2, 0), (3, 5), (4, 2)])) == 4
    assert sorted(r["key"] for r in server.items("d").collect()) == [2, 3, 4]
    assert server.insert("d", frame(spark, [(4, 7)])) == 0
    client.mutate_priorities("d", {2: 9.0, 77: 1.0}, [3, 2])
    assert [(r["key"], r["priority"]) for r in server.items("d").collect()] == [(4, 7.0)]
    server.insert("d", frame(spark, [(5, 0)]))
    got = client.sample("d", 3, seed=1).collect()
    assert [r["info"]["key"] for r in got] == [4, 4, 4] and sorted(r["info"]["times_sampled"] for r in got) == [1, 2, 3] and got[0]["info"]["table_size"] == 2
    server.insert("q", frame(spark, [(1, 1), (2, 1)]))
    with pytest.raises(Deferred):
        server.insert("q", frame(spark, [(3, 1)]))
    assert [r["info"]["key"] for r in client.sample("q", 2).orderBy("draw").collect()] == [1, 2] and server.items("q").count() == 0
    client.checkpoint()
    again = Server(spark, [Table("other", K.Fifo(), K.Fifo(), 1, L.MinSize(1))], Checkpointer(spark, str(tmp_path / "none"), fallback=str(tmp_path / "c")))
    assert [t.name for t in again.tables] == ["d", "q", "seen"] and again.items("d").count() == 2 and again.info().where("name = 'd'").first()["samples"] == 3
    client.reset("d")
    assert server.items("d") is None
    with pytest.raises(ValueError):
        client.insert(spark.range(1), {"q": -1.0})


def test_items_share_chunks(spark, tmp_path):
    server = Server(spark, [Table("a", K.Fifo(), K.Fifo(), 2, L.MinSize(1)), Table("b", K.Fifo(), K.Fifo(), 2, L.MinSize(1))], Checkpointer(spark, str(tmp_path / "c")))
    chunks = spark.createDataFrame([(c, [c * 10, c * 10 + 1]) for c in range(5)], "chunk_key long, data array<long>")

    def items(*rows):
        made = [(k, 1.0, said, [(False, [(c, o, n, 0) for c, o, n in slices])]) for k, said, slices in rows]
        return spark.createDataFrame(made, "key long, priority double, chunk_keys array<long>, columns array<struct<squeeze boolean, slices array<struct<chunk_key long, offset int, length int, index int>>>>")

    held = lambda s: sorted(r["chunk_key"] for r in s.chunks().collect())
    for bad in (items((1, [1], [(0, 0, 1)])), items((1, [9], [(9, 0, 1)])), items((1, [], []))):
        with pytest.raises(ValueError):
            server.insert_trajectories("a", bad, chunks)
    assert server.chunks() is None and server.items("a") is None
    assert server.insert_trajectories("a", items((1, [0], [(0, 0, 2)]), (2, [0, 1], [(0, 1, 1), (1, 0, 2)])), chunks) == 2
    assert held(server) == [0, 1]
    server.insert_trajectories("b", items((7, [1, 2], [(1, 1, 1), (2, 0, 1)])), chunks.where("chunk_key = 2"))  # chunk 1 is there
    server.insert_trajectories("a", items((3, [3], [(3, 0, 1)]), (4, [4], [(4, 1, 1)])), chunks)  # both older items go
    assert held(server) == [1, 2, 3, 4]
    drawn = server.sample("b", 1)
    assert [(r["column"], r["values"]) for r in server.cells(drawn, "draw").collect()] == [(0, [11, 20])]
    server.mutate("b", deletes=spark.createDataFrame([(7,)], "key long"))
    folder = server.checkpoint()
    again = Server(spark, server.tables, Checkpointer(spark, str(tmp_path / "c")))
    assert held(again) == [3, 4] and sorted(r["values"] for r in again.cells(again.items("a"), "key").collect()) == [[30], [41]]
    spark.read.parquet(f"{folder}/chunks").where("chunk_key = 3").write.parquet(str(tmp_path / "less"))
    (tmp_path / "c").joinpath(folder.rsplit("/", 1)[1], "chunks").rename(tmp_path / "old")
    (tmp_path / "less").rename(tmp_path / "c" / folder.rsplit("/", 1)[1] / "chunks")
    with pytest.raises(ValueError, match="lacks a chunk"):
        Server(spark, server.tables, Checkpointer(spark, str(tmp_path / "c")))


def test_extension_signature_and_patterns(spark):
    table = Table("a", K.Fifo(), K.Fifo(), 10, L.MinSize(1), signature=T.StructType([T.StructField("x", T.ArrayType(T.LongType()))]))
    server = Server(spark, [table, Table("seen", K.Fifo(), K.Fifo(), 10, L.MinSize(1))])
    server.tables = [table.replace(extensions=(copy_on_first_sample(server, "a", "seen"),)), server.tables[1]]
    steps = spark.createDataFrame([("s", i, i) for i in range(4)], "stream string, at int, v long")
    assert Client(server).write_patterns(steps, [create_config({"x": create_reference_step()["v"][-2:]}, "a")], ["stream"], ["at"]) == {"a": 3}
    rows = Client(server).sample("a", emit_timesteps=True, columns=["x"]).collect()
    assert len(rows) == 2
    assert [r["times_sampled"] for r in server.items("seen").collect()] == [1]
    with pytest.raises(ValueError, match="column"):
        server.insert("a", frame(spark, [(1, 1)]).withColumn("x", F.lit("no")))


def test_samples_pass_over_used_items(spark):
    server = Server(spark, [Table("a", K.Fifo(), K.Fifo(), 10, L.MinSize(1), max_times_sampled=2)])
    server.insert("a", frame(spark, [(1, 1), (2, 1), (3, 1)]))
    keys = lambda n: [(r["draw"], r["info"]["key"], r["info"]["times_sampled"]) for r in server.sample("a", n).orderBy("draw").collect()]
    assert keys(1) == [(0, 1, 1)]
    assert keys(2) == [(0, 1, 2), (1, 2, 1)]
    assert keys(3) == [(0, 2, 2), (1, 3, 1), (2, 3, 2)]
    assert server.items("a").count() == 0


def test_written_patterns_keep_the_order_of_steps(spark):
    ref = create_reference_step()
    steps = spark.createDataFrame([(f"s{i % 2}", i, i) for i in random.Random(6).sample(range(60), 60)], "stream string, at int, v long").repartition(3)
    for remover, want in ((K.Fifo(), range(53, 60)), (K.Lifo(), range(7)), (K.MinHeap(), range(53, 60))):
        server = Server(spark, [Table("a", K.Fifo(), remover, 7, L.MinSize(1), max_times_sampled=1)])
        assert Client(server).write_patterns(steps, [create_config({"x": ref["v"][-1:]}, "a")], ["stream"], ["at"]) == {"a": 60}
        assert sorted(r["x"][0] for r in server.items("a").collect()) == list(want)
        assert [r["x"][0] for r in server.sample("a", 7).orderBy("draw").collect()] == list(want)
    server = Server(spark, [Table("a", K.Fifo(), K.Fifo(), 4, L.MinSize(1))])
    both = [create_config({"x": ref["v"][-1:]}, "a"), create_config({"x": ref["v"][-2:]}, "a")]
    assert Client(server).write_patterns(steps, both, ["stream"], ["at"]) == {"a": 118}
    assert sorted(r["x"] for r in server.items("a").collect()) == [[56, 58], [57, 59], [58], [59]]


def test_mutations(spark):
    log = spark.createDataFrame([("t", 1, 0, 1.0, "a"), ("t", 1, 1, 2.0, "b"), ("t", 2, 2, 3.0, "c")], "table string, key long, op_seq long, priority double, d string")
    got = sorted((r["key"], r["priority"], r["d"]) for r in M.insert_or_assign(log, ("d",)).collect())
    assert got == [(1, 2.0, "a"), (2, 3.0, "c")]


def test_streams(spark, tmp_path):
    schema = "table string, op_seq long, op string"
    for i in range(2):
        spark.createDataFrame([("t", 3 * i + j, op) for j, op in enumerate(["insert", "sample", "insert"])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limit = L.RateLimiter(1.0, 1, 0.0, 2.0)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = admit_stream(source(), limit).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = L.admit(spark.read.parquet(str(tmp_path / "in")), limit).collect()
    assert spark.table("admitted").count() == 6 and sum(r["admitted"] for r in spark.table("admitted").collect()) == sum(r["admitted"] for r in want)
    q = sliding_stream(source().withColumn("v", F.col("op_seq") * 10), ["table"], "op_seq", ["v"], 3).writeStream.format("memory").queryName("slid").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(len(r["v"]) for r in spark.table("slid").collect()) == [3, 3, 3, 3]
    q = apply_batches(source(), lambda d: d.groupBy("op").count(), str(tmp_path / "out"), str(tmp_path / "c3"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 6


def test_overflowing_batches(spark):
    server = Server(spark, [Table("t", K.Uniform(), K.Fifo(), 2, L.MinSize(1))])
    server.insert("t", frame(spark, [(1, 1), (2, 1), (3, 1)]))
    assert sorted(r["key"] for r in server.items("t").collect()) == [2, 3]
    again = spark.createDataFrame([(4, 1.0, 0), (5, 1.0, 1), (4, 2.0, 2)], "key long, priority double, op_seq long")
    for rows in (again, frame(spark, [(2, 5), (9, 1)])):
        with pytest.raises(ValueError, match="twice"):
            server.insert("t", rows)
    assert sorted(r["key"] for r in server.items("t").collect()) == [2, 3]
    server.insert("t", frame(spark, [(1, 7)]))
    assert sorted(r["key"] for r in server.items("t").collect()) == [1, 3]


def test_events_reach_extensions(spark):
    class Log(TableExtension):
        def __init__(self):
            self.seen = []

        def on_insert(self, items):
            self.seen.append(("insert", sorted(r["key"] for r in items.collect())))

        def on_delete(self, items):
            self.seen.append(("delete", sorted(r["key"] for r in items.collect())))

        def on_update(self, items):
            self.seen.append(("update", sorted(r["key"] for r in items.collect())))

    log = Log()
    server = Server(spark, [Table.queue("q", 3, extensions=(log,)), Table("t", K.Uniform(), K.Fifo(), 2, L.MinSize(1), extensions=(log,))])
    client = Client(server)
    server.insert("t", frame(spark, [(1, 1), (2, 1), (3, 1)]))
    client.mutate_priorities("t", {3: 4.0}, [2])
    server.insert("q", frame(spark, [(7, 1), (8, 1)]))
    client.sample("q", 1)
    assert log.seen == [("insert", [1, 2, 3]), ("delete", [1]), ("update", [3]), ("delete", [2]), ("insert", [7, 8]), ("delete", [7])]


def test_config_options_and_signature(spark):
    config = [{"name": "a", "sampler": {"kind": "prioritized", "exponent": 0.5}, "remover": {"kind": "fifo"}, "max_size": 4, "max_times_sampled": 2, "rate_limiter": {"samples_per_insert": 1.0, "min_size_to_sample": 1, "min_diff": -9.0, "max_diff": 9.0}}]
    server = Server.from_config(spark, config)
    assert server.table("a") == Table("a", K.Prioritized(0.5), K.Fifo(), 4, L.RateLimiter(1.0, 1, -9.0, 9.0), 2)
    for bad in ({"max_samples": 0}, {"max_in_flight": 0}, {"num_workers": 0}, {"max_samples_per_stream": -2}, {"timeout_ms": -2}):
        with pytest.raises(ValueError):
            SampleOptions(**bad)
    assert SampleOptions(max_samples=1, timeout_ms=0).max_in_flight == 100
    signed = Server(spark, [Table("s", K.Fifo(), K.Fifo(), 4, L.MinSize(1), signature=T.StructType([T.StructField("y", T.LongType()), T.StructField("x", T.LongType())]))])
    signed.insert("s", spark.createDataFrame([(1, 1.0, 5, 6)], "key long, priority double, x long, y long"))
    assert signed.trajectories("s").columns == ["info", "y", "x"]
    with pytest.raises(ValueError, match="signature"):
        server.trajectories("a")
    with pytest.warns(UserWarning, match="upper bound"):
        L.SampleToInsertRatio(2.0, 10, (0.0, 8.0))


def test_restore_refuses_a_key_twice(spark):
    checkpoints = Checkpointer.temporary(spark)
    server = Server(spark, [Table("d", K.Uniform(), K.Fifo(), 3, L.MinSize(1))], checkpoints)
    server.insert("d", frame(spark, [(1, 1), (2, 1)]))
    server._states["d"].items = server.items("d").union(server.items("d"))
    server.checkpoint()
    with pytest.raises(ValueError, match="twice"):
        Server(spark, server.tables, checkpoints)


def test_calls_with_lists(spark):
    tables = [Table(n, K.Fifo(), K.Fifo(), 10, L.MinSize(1)) for n in "ab"]
    client = Client(Server(spark, tables))
    row = spark.createDataFrame([(5,)], "x long")
    for names, priorities in ((["a"], [1.0, 2.0]), ("ab", [1.0, 2.0]), (["a", "b"], [1.0, float("nan")])):
        with pytest.raises(ValueError):
            client.insert_into(row, names, priorities)
    with pytest.raises(KeyError):
        client.insert_into(row, ["a", "none"], [1.0, 2.0])
    assert client.server.items("a") is None
    client.insert_into(row, ["a", "b"], [1.0, 2.0])
    key = client.server.items("b").first()["key"]
    with pytest.raises(ValueError):
        client.update_priorities("b", [key], [])
    client.update_priorities("b", [key, 12345], [7.0, 1.0])
    assert [client.server.items(n).first()["priority"] for n in "ab"] == [1.0, 7.0]


def test_flushed_chunks_and_shapes(spark):
    rows = [(i, None if i == 4 else i, i in (1, 4, 5)) for i in range(9)]
    made = C.build_chunks(spark.createDataFrame([(0, *r) for r in rows], "s long, step long, v long, f boolean"), ["s"], "step", "v", 3, F.col("f"))
    assert [r["data"] for r in made.orderBy("chunk_no").collect()] == [[0, 1], [2, 3], [5], [6, 7, 8]]
    cells = spark.createDataFrame([([[1, 2], [3, 4]],), ([[1], [2, 3]],), ([[1], None],), ([],)], "c array<array<int>>")
    assert [r[0] for r in cells.select(A.same_shape(F.col("c"))).collect()] == [True, False, False, True]
    with pytest.raises(Exception, match="different shapes"):
        cells.select(A.require_same_shape(F.col("c"))).collect()


def test_missing_cells(spark):
    d = spark.createDataFrame([([1, None, 3],)], "x array<int>")
    assert d.select(A.require_cells(A.gather(F.col("x"), [0, -1])).alias("y")).first()["y"] == [1, 3]
    for bad in (A.gather(F.col("x"), [1]), A.gather(F.col("x"), [5])):
        with pytest.raises(Exception, match="missing"):
            d.select(A.require_cells(bad)).collect()
