import duckdb
import pytest

import __spark_entry__ as entry
from strandloom import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(None if x != x else round(x, 9) if isinstance(x, float) else x for x in r)) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(core.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(core.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_samples_are_whole(spark):
    for name in ("seeded_prioritized_sample", "seeded_uniform_sample"):
        assert core.QUERIES[name](spark, SF).groupBy("table").count().where("count <> 500").count() == 0


def test_references_of_all_lines(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    assert core.QUERIES["chunk_refcount_all"](spark, SF).agg({"num_items": "sum"}).first()[0] == lines.count()
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()
    live, orphans = (core.QUERIES[f"{x}_chunks_by_status"](spark, "/root/testdata/sf0.01").count() for x in ("live", "orphan"))
    assert orphans > 0 and live + orphans == parts


def test_whole_trajectories(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").count()
    gathered = core.QUERIES["trajectory_gather_whole"](spark, SF).select("lengths").collect()
    assert sum(len(r["lengths"].split(",")) for r in gathered) == turns
