"""Trajectories: from items over chunks to columns, and from columns to rows of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assemble(slices: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("key", "column")) -> DataFrame:
    """One row per item and column with its cells: slices (``slice_no``, chunk_key, offset, length) joined with chunks.

    A missing chunk or a slice that leaves its chunk is an error.
    """
    found = slices.join(chunks.select("chunk_key", "data"), "chunk_key", "left")
    part = (
        F.when(F.col("data").isNull(), F.raise_error(F.lit("a chunk of this item is missing")))
        .when((F.col("offset") < 0) | (F.col("offset") + F.col("length") > F.size("data")), F.raise_error(F.lit("a slice leaves its chunk")))
        .otherwise(F.slice("data", F.col("offset").cast("int") + 1, F.col("length").cast("int")))
    )
    parts = found.select(*keys, F.struct(F.col("slice_no"), part.alias("part")).alias("_s"))
    return parts.groupBy(*keys).agg(F.flatten(F.expr("transform(sort_array(collect_list(_s)), s -> s.part)")).alias("values"))


def unpack_column(chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """A bounds-checked slice of every chunk's cells."""
    bad = (F.lit(offset) < 0) | (F.lit(offset + length) > F.size("data"))
    return chunks.withColumn("data", F.when(bad, F.raise_error(F.lit("a slice leaves its chunk"))).otherwise(F.slice("data", offset + 1, length)))


def explode_timesteps(items: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per step of each trajectory, its keys repeated; columns must be equally long."""
    equal = F.lit(True)
    for c in columns[1:]:
        equal = equal & (F.size(c) == F.size(columns[0]))
    zipped = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("columns of a timestep trajectory differ in length")))
    return items.select(*keys, F.posexplode(zipped).alias("t", "_s")).select(*keys, "t", *[F.col(f"_s.{c}").alias(c) for c in columns])


def complete_episodes(steps: DataFrame, episode: str, step: str, observation: str, action: str) -> DataFrame:
    """Whole episodes as two columns: observations, and one action fewer, as the last step's is none.

    An episode is one row, so its length is bounded by what a row can hold, as an item's is.
    """
    ordered = F.sort_array(F.collect_list(F.struct(step, observation, action)))
    rows = steps.groupBy(episode).agg(ordered.alias("_s"))
    return rows.select(episode, F.col(f"_s.{observation}").alias("observations"), F.slice(F.col(f"_s.{action}"), 1, F.greatest(F.lit(0), F.size("_s") - 1)).alias("actions"))


def nest(df: DataFrame, columns: Sequence[str], separator: str = "/") -> DataFrame:
    """Columns named ``a/b`` as nested structs, the others as they are."""

    def tree(names: list[tuple[tuple[str, ...], str]]) -> list:
        out = []
        for head in dict.fromkeys(path[0] for path, _ in names):
            mine = [(path[1:], full) for path, full in names if path[0] == head]
            out.append(F.col(f"`{mine[0][1]}`").alias(head) if mine[0][0] == () else F.struct(*tree(mine)).alias(head))
        return out

    return df.select(*[c for c in df.columns if c not in columns], *tree([(tuple(c.split(separator)), c) for c in columns]))


def flatten_schema(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Leaves by ``/``-joined names, field names sorted as in nested dicts."""
    out: dict[str, T.DataType] = {}
    for f in sorted(schema.fields, key=lambda f: f.name):
        name = f"{prefix}/{f.name}" if prefix else f.name
        out |= flatten_schema(f.dataType, name) if isinstance(f.dataType, T.StructType) else {name: f.dataType}
    return out


def check_signature(schema: T.StructType, signature: T.StructType) -> None:
    """Raises where names or types of the leaves differ from the declared ones."""
    got, want = flatten_schema(schema), flatten_schema(signature)
    for name in sorted(got.keys() | want.keys()):
        if got.get(name) != want.get(name):
            raise ValueError(f"column {name}: expected {want.get(name)}, got {got.get(name)}")


def wrong_lengths(items: DataFrame, lengths: dict[str, int | None]) -> DataFrame:
    """Items whose array columns have not the declared length (None: any)."""
    bad = F.lit(False)
    for c, n in lengths.items():
        bad = bad | F.col(c).isNull() | (F.lit(False) if n is None else F.size(c) != n)
    return items.where(bad)
