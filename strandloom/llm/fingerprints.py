"""Operator 4: document fingerprints as quartile bucket digests.

Hashed byte triplets of a text are counted in 128 buckets. The digest holds the text's length on a logarithmic scale,
two quotients of the buckets' quartiles, and for each bucket the quartile (0 to 3) that its count falls in. Two digests
are compared by a bounded sum of bucket, quotient and length differences, scaled to a likeness from 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import slices, strings

BUCKETS = 128
#: Cost of a bucket's step between quartiles: neighbours differ little, opposite ends much.
STEP_COST = np.array([0, 1, 2, 6], np.int64)
LENGTH_CAP, QUOTIENT_CAP = 24, 12
#: Unrelated texts differ by about this much; likeness 0 starts here.
FAR = 240.0


def digests(texts: list[bytes]) -> np.ndarray:
    """One row per text: length code, two quotient codes, then BUCKETS quartile codes (all uint8).

    Empty texts and texts under three bytes have no triplet: all their buckets are 0.
    """
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(data) > 2:
        place = ((data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(25)
    ends = np.cumsum(sizes)
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for i in np.flatnonzero(sizes > 2).tolist():
        counts[i] = np.bincount(place[ends[i] - sizes[i] : ends[i] - 2], minlength=BUCKETS)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, [BUCKETS * k // 4 - 1]] for k in (1, 2, 3))
    out[:, 3:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    out[:, 0] = np.minimum(255, np.round(np.log1p(sizes) / np.log(1.1))).astype(np.uint8)
    safe = np.maximum(q3[:, 0], 1)
    out[:, 1], out[:, 2] = q1[:, 0] * 15 // safe, q2[:, 0] * 15 // safe
    return out


def pack(digest: np.ndarray) -> list[str]:
    """Digests as hexadecimal strings: four buckets to a byte."""
    b = digest[:, 3:].reshape(len(digest), -1, 4)
    codes = b[:, :, 0] << 6 | b[:, :, 1] << 4 | b[:, :, 2] << 2 | b[:, :, 3]
    return [row.tobytes().hex() for row in np.concatenate([digest[:, :3], codes], axis=1)]


def unpack(fingerprints: list[str]) -> np.ndarray:
    raw = np.array([np.frombuffer(bytes.fromhex(f), np.uint8) for f in fingerprints]).reshape(len(fingerprints), 3 + BUCKETS // 4)
    quartiles = (raw[:, 3:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate([raw[:, :3], quartiles.reshape(len(raw), -1)], axis=1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling to 0 with the difference score (bucket steps, quotients, length; the last two capped)."""
    gap = np.abs(a.astype(np.int64) - b.astype(np.int64))
    score = STEP_COST[gap[:, 3:]].sum(axis=1) + np.minimum(gap[:, 0], LENGTH_CAP) + np.minimum(gap[:, 1] + gap[:, 2], QUOTIENT_CAP)
    return np.maximum(0.0, 1.0 - score / FAR)


def range_number(value: Column, bounds: list[int]) -> Column:
    """The range of ``value`` among ascending bounds, a number that rises with it; 0 for null and the lowest.

    Bounds are searched in two steps, blocks first, so that a row meets some 2 sqrt(n) of n bounds.
    """
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    passed = lambda some: F.aggregate(some, F.lit(0), lambda n, b: n + (value > b).cast("int"))
    block = passed(F.lit([b[-1] for b in blocks]).cast("array<long>"))
    inner = F.get(F.array(*[F.lit(b).cast("array<long>") for b in blocks]), block)
    return F.coalesce(block * width + F.coalesce(passed(inner), F.lit(0)), F.lit(0))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): every document and the one after it by ascending doc_id; after the last comes the first.

    Ids are cut into ranges, each range is sorted, and the first document of every range is also handed to the range
    before it, so no task sees more than its range. Order among equal ids is that of their texts; null ids come first.
    A null text is an empty one. One row per input row; a table of one row follows itself.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] or []  # n - 1 numbers
    bounds = sorted({int(b) for b in bounds})
    # Rows of one id that fills many ranges stay in one: ids are meant to be unique, and ties need each other's order.
    number = range_number(F.col("doc_id"), bounds)
    ranged = docs.withColumn("range", number)
    first = ids.withColumn("range", number).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id")).alias("m")).select("range", "m.doc_id").orderBy("range").collect()  # one row per range
    if not first:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    heads = spark.createDataFrame([(r["doc_id"], first[i - 1]["range"]) for i, r in enumerate(first)], "head long, range int")
    # At most n heads, n being the parameter above.
    handed = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    handed = handed.groupBy("doc_id", "range").agg(F.min("text").alias("text")).select("doc_id", "text", "range")
    both = ranged.withColumn("head", F.lit(0)).unionByName(handed.withColumn("head", F.lit(1)))
    order = Window.partitionBy("range").orderBy("head", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("head = 0").select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): equal texts have equal fingerprints; a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = strings(batch, "text").cast(pa.large_binary()).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(pack(digests(texts)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    pairs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "next_text", edited.alias("edited"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own, follow, other = (digests(strings(batch, c).cast(pa.large_binary()).to_pylist()) for c in ("text", "next_text", "edited"))
            yield pa.record_batch(
                [batch.column(0), batch.column(4), batch.column(5), *(pa.array(pack(d), pa.string()) for d in (own, other)), pa.array(likeness(own, other)), pa.array(likeness(own, follow))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    rows = pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)})
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
