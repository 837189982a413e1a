import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.patterns import Condition, apply_pattern, apply_patterns, constant_priority, create_config, create_reference_step, infer_signature, pattern_from_transform, td_error, with_info
from strandloom.sources import steps as S

REF = create_reference_step()


def stream(spark, values, last=()):
    return spark.createDataFrame([("s", i, v, i in last) for i, v in enumerate(values)], "stream string, at int, v long, is_last boolean")


def fired(df, conditions, nodes=None, **more):
    return sorted(r["at"] for r in apply_pattern(df, create_config(nodes or {"x": REF["v"][-1]}, "t", conditions), ["stream"], ["at"], **more).collect())


def test_conditions(spark):
    ten = stream(spark, range(10))
    assert fired(ten, (Condition.steps_since_applied() >= 4,)) == [3, 7]
    assert fired(ten, (Condition.steps_since_applied() >= 3,)) == [2, 5, 8]
    assert fired(ten, (Condition.step_index() % 3 != 0,)) == [1, 2, 4, 5, 7, 8]
    assert fired(ten, (Condition.step_index() <= 2,)) == [0, 1, 2]
    assert fired(ten, (Condition.step_index() > 7,)) == [8, 9]
    assert fired(ten, (Condition.data("v") == 4,)) == [4]
    assert fired(ten, (Condition.data("v") != 4, Condition.step_index() < 6)) == [0, 1, 2, 3, 5]
    assert fired(ten, (Condition.buffer_length() >= 2,), {"x": REF["v"][-2:]}) == list(range(1, 10))


def test_null_and_float_data_conditions_are_false(spark):
    df = stream(spark, [1, None, 3]).withColumn("f", F.lit(1.0))
    assert fired(df, (Condition.data("v") != 9,), {"x": REF["at"][-1]}) == [0, 2]
    assert fired(df, (Condition.data("f") != 9,), {"x": REF["at"][-1]}) == []


def test_strides_and_nulls(spark):
    df = stream(spark, [0, 1, 2, 3, None, 5, 6, 7, 8])
    rows = apply_pattern(df, create_config({"x": REF["v"][-5::2]}, "t"), ["stream"], ["at"]).orderBy("at").collect()
    assert [(r["at"], r["x"]) for r in rows] == [(5, [1, 3, 5]), (7, [3, 5, 7])]
    rows = apply_pattern(df, create_config({"x": REF["v"][-3:-1]}, "t"), ["stream"], ["at"]).orderBy("at").collect()
    assert [(r["at"], r["x"]) for r in rows] == [(2, [0, 1]), (3, [1, 2]), (7, [5, 6]), (8, [6, 7])]  # step 4 is null, so not evaluated


def test_unevaluated_steps_keep_the_index_but_not_the_counter(spark):
    df = stream(spark, [0, None, 2, 3, 4])
    assert fired(df, (Condition.steps_since_applied() >= 2,)) == [2, 4]
    assert fired(df, (Condition.step_index() == 2,)) == [2]


def test_episodes(spark):
    df = S.number_episodes(stream(spark, range(7), last=(3, 6)), ["stream"], ["at"], F.col("is_last"))
    pair = {"x": REF["v"][-2:]}
    assert len(fired(df, (), pair, episode="episode")) == 5 and len(fired(df, (), pair)) == 6
    assert fired(df, (Condition.is_end_episode(),), pair, episode="episode", end=F.col("is_last")) == [3, 6]
    # the counter goes on over the ends of episodes
    assert fired(df, (Condition.steps_since_applied() >= 5,), episode="episode") == [4]


def test_td_error(spark):
    df = stream(spark, [1, -3, 2])
    config = create_config({"x": REF["v"][-2:]}, "t", (), td_error(0.5, "v"))
    assert [r["priority"] for r in apply_pattern(df, config, ["stream"], ["at"]).orderBy("at").collect()] == [2.5, 2.75]
    missing = create_config({"x": REF["at"][-1]}, "t", (), td_error(0.5, "v"))
    assert {r["priority"] for r in apply_pattern(df, missing, ["stream"], ["at"]).collect()} == {0.0}


def test_validation():
    for bad in (slice(None, -1), slice(-1, -2), slice(-2, None, 0), slice(0, 1), slice(-3, 1)):
        with pytest.raises(ValueError):
            REF["x"][bad]
    with pytest.raises(ValueError):
        create_config({}, "t")
    with pytest.raises(ValueError):
        create_config({"x": REF["x"][-1]}, "")
    with pytest.raises(ValueError):
        Condition.step_index() % 0
    with pytest.raises(ValueError):
        constant_priority(-1)
    with pytest.raises(ValueError):
        create_config({"x": 3}, "t")


def test_signature_and_nesting(spark):
    pattern = pattern_from_transform(lambda s: {"b": {"c": s["v"][-2:]}, "a": s["v"][-1]})
    config = create_config(pattern, "t")
    assert list(config.nodes) == ["a", "b/c"] and config.history == 2
    schema = T.StructType([T.StructField("v", T.LongType())])
    found = infer_signature([config, create_config({"a": REF["v"][-1], "b": {"c": REF["v"][-5:]}}, "t")], schema)
    assert found["b/c"].dataType == T.ArrayType(T.LongType())
    with pytest.raises(ValueError):
        infer_signature([config, create_config({"a": REF["v"][-1]}, "t")], schema)
    row = with_info(apply_pattern(stream(spark, [1, 2]), config, ["stream"], ["at"])).first()
    assert row["info"]["table_size"] == 0 and row["b/c"] == [1, 2]
    assert apply_pattern(stream(spark, []), config, ["stream"], ["at"]).count() == 0


def test_steps(spark):
    parts = spark.createDataFrame([(1, 5, None), (1, None, 6), (2, 7, None)], "k int, a int, b int")
    assert sorted(map(tuple, S.merge_partial_steps(parts, ["k"], ["a", "b"]).collect())) == [(1, 5, 6), (2, 7, None)]
    with pytest.raises(Exception, match="set twice"):
        S.merge_partial_steps(parts.union(parts), ["k"], ["a", "b"]).collect()
    with pytest.raises(Exception, match="differ in length"):
        S.append_sequence(spark.createDataFrame([(1, [1, 2], [1])], "k int, a array<int>, b array<int>"), ["k"], ["a", "b"]).collect()


def test_configs_share_one_window(spark, capsys):
    """Items of several configs, one of which counts steps since it fired, are what each makes by itself, by one sort."""
    df = stream(spark, [0, 1, None, 3, 4, 5, 6])
    plain = [create_config({"x": REF["v"][-2:], "y": REF["v"][-1]}, "a"), create_config({"x": REF["v"][-3:-1], "y": REF["v"][-1]}, "b", (Condition.step_index() % 2 == 0,), td_error(0.5, "v"))]
    late = create_config({"x": REF["v"][-2:], "y": REF["v"][-2]}, "c", (Condition.steps_since_applied() >= 2,))
    key = lambda r: (r["table"], r["at"], r["priority"], r["x"], r["y"])
    configs = [*plain, late]
    alone = [(i, *key(r)) for i, c in enumerate(configs) for r in apply_pattern(df, c, ["stream"], ["at"]).collect()]
    together = apply_patterns(df, configs, ["stream"], ["at"]).collect()
    assert sorted((r["config_idx"], *key(r)) for r in together) == sorted(alone) and len({r["config_idx"] for r in together}) == 3
    capsys.readouterr()
    apply_patterns(df, plain, ["stream"], ["at"]).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    with pytest.raises(ValueError, match="same output"):
        apply_patterns(df, [plain[0], create_config({"z": REF["v"][-1]}, "a")], ["stream"], ["at"])
