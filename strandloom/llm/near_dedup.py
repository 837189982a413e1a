"""Operator 2: near-duplicates by SuperMinHash, banding, verification on full sets, and union-find grouping.

SuperMinHash gives every shingle a random permutation of the slots, drawn step by step, and its j-th slot the rank
j + r with r in [0, 1). A slot keeps its least rank. Ranks of one shingle are correlated, which lowers the variance of
the estimate below that of MinHash, and a document stops as soon as all its slots are filled: later ranks are larger.

Documents with equal shingle sets are one class. Classes that share a band are candidates. In each shared bucket the
members are first held against its centre only (a star), so a group of n near copies costs n comparisons for each centre
that its buckets have, not n^2 / 2.
The centre is the member with most company over all of its buckets: of an original and its edited copies the original.
Candidates that are still in different components afterwards are compared too, bucket members outside the bucket's
largest component against the others, so that no candidate link is lost. Rare shingles, those of few sets, spare most
of these pairs: two sets share no more than the fewer of their other shingles, and the rare ones that both have, which
are counted for each such pair. Pairs for which this is too few are not made. An edited copy that strays far
from its group has its edits to itself, so this bound settles it without comparing it with the group. All links are
confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, join_hot, spread
from .text import GOLDEN, lengths_to_rows, mix, ragged, slices, split_words, strings, word_hashes

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 slots: a pair at the threshold of 0.75 shares none with probability 5e-6.
BANDS, ROWS = 32, 4
#: Shingles of up to so many sets are rare: for each of them, the pairs of its sets are few.
RARE = 6
EMPTY = np.uint64(2**64 - 1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, and offsets.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle; one without words has none.
    """
    offsets, codes, vocabulary = split_words(texts, lower=True)
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    hashed = np.concatenate([word_hashes(vocabulary, 2)[codes] if len(vocabulary) else np.zeros(0, np.uint64), np.zeros(width, np.uint64)])
    at = ragged(offsets[:-1], count)
    short = np.repeat(n < width, count)
    length = np.repeat(np.minimum(n, width), count)
    h = mix(length.astype(np.uint64) * GOLDEN)
    for k in range(width):
        word = hashed[at + k] if not short.any() else np.where(k < length, hashed[at + k], np.uint64(0))
        h = mix(h + word * np.uint64(2 * k + 3))
    doc = lengths_to_rows(count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int64)


def super_min_hash(h: np.ndarray, offsets: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``slots`` ranks per set: the step in the upper, the fraction in the lower 32 bits. EMPTY for empty sets."""
    n = np.diff(offsets)
    sketch = np.full((len(n), slots), EMPTY)
    flat, doc = sketch.reshape(-1), lengths_to_rows(n)
    perm = None
    for j in range(slots):
        x = mix(h + np.uint64((j + 1) * int(GOLDEN) % 2**64))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(h))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(flat, doc * slots + slot, np.uint64(j << 32) | x >> np.uint64(32))
        open_ = (sketch == EMPTY).any(axis=1)[doc]
        if not open_.any():
            break
        h, doc = h[open_], doc[open_]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
            perm[np.arange(len(h)), k[open_]] = 0
        elif not open_.all():
            perm = perm[open_]
    return sketch


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), parts.shape[:2])
    for r in range(parts.shape[2]):
        key = mix(key + parts[:, :, r] * np.uint64(2 * r + 3))
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands): set_key names the shingle set (16 bytes, null for empty ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            h, offsets = shingle_sets(strings(batch, "text"))
            n = np.diff(offsets)
            bands = band_keys(super_min_hash(h, offsets))
            keys = [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n), pa.array(keys, pa.binary()), lists], names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return read.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_key, text): one text for each of the classes ``wanted`` (set_key)."""
    wanted = classes.join(wanted, "set_key").select("set_key", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    return texts.groupBy("set_key").agg(F.first("text").alias("text"))  # rows that are repeated in full


def _rare_shingles(texts: DataFrame) -> DataFrame:
    """(sets, rare): how many shingles all of ``sets`` (a sorted array of 1 to RARE classes) and no other class among ``texts`` have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            h, offsets = shingle_sets(strings(batch, "text"))
            keys = batch.column(0).take(pa.array(lengths_to_rows(np.diff(offsets))))
            yield pa.record_batch([keys, pa.array(h.view(np.int64))], names=["set_key", "shingle"])

    held = cut(texts.mapInArrow(run, "set_key binary, shingle long"), "shingles")
    few = held.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("set_key").alias("u"), F.max("set_key").alias("v"))
    few = cut(few.where(F.col("sets") <= RARE), "few")
    more = held.join(few.where("sets > 2").select("shingle"), "shingle").groupBy("shingle").agg(F.sort_array(F.collect_list("set_key")).alias("sets"))
    sets = few.where("sets <= 2").select(F.array_distinct(F.array("u", "v")).alias("sets")).union(more.select("sets"))
    return cut(sets.groupBy("sets").agg(F.count("*").alias("rare")), "rare")


def _beside(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str, other: str, name: str, floor: int = 200, most_hot: int = 20_000) -> DataFrame:
    """``rows``, which are those of ``pairs`` (a written table), with the text of class ``side`` as column ``name``.

    Where a class has more than ``floor`` pairs (the centre of a large group) its text is repeated for parts of them, so
    that no task gets all; repeated texts are no more than one for ``floor`` pairs. Fewer than ``most_hot`` classes have
    more than 1 / ``most_hot`` of all pairs, which is what is broadcast.
    """
    held = pairs.groupBy(F.col(side).alias("_key")).agg(F.count("*").alias("_n"))
    found = held.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    limit = max(floor, (found["total"] or 0) // most_hot)
    texts = texts.select(F.col("set_key").alias(side), F.col("text").alias(name))
    if (found["top"] or 0) <= limit:
        return rows.join(texts, side)
    hot = F.broadcast(held.where(F.col("_n") > limit).select(F.col("_key").alias(side), F.ceil(F.col("_n") / limit).alias("_parts")))
    part = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1)))
    dealt = rows.join(hot, side, "left").withColumn("_part", part).drop("_parts")
    copies = texts.join(hot, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [side, "_part"]).drop("_part")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v, other columns; a written table) whose full shingle sets are alike enough. Texts are fetched for these classes only."""
    columns = pairs.columns
    texts = _texts(pairs.select(F.col("u").alias("set_key")).union(pairs.select("v")).distinct(), classes, docs)
    full = _beside(_beside(pairs, pairs, texts, "u", "v", "text"), pairs, texts, "v", "u", "other_text").select("text", "other_text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            (a, at), (b, bt) = (shingle_sets(strings(batch, c)) for c in ("text", "other_text"))
            common = np.array([len(np.intersect1d(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]], assume_unique=True)) for i in range(batch.num_rows)], np.int64)
            alike = 100 * common >= PERCENT * (np.diff(at) + np.diff(bt) - common)
            yield batch.select(columns).filter(pa.array(alike))

    return cut(full.mapInArrow(run, pairs.schema), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id of its group), kept (doc_id is that least one).

    Nulls: a null text is an empty one; texts without words are linked with nothing. A row with a null doc_id takes
    part, gets its group's least id (null if it is alone) and is kept only if that is null. Repeated rows get equal
    results. Extra columns are ignored; an empty table gives no rows.
    """
    return grouped_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with each row's text_hash and the root of its group, null for a text that is linked with nothing
    because it has no words."""
    rows = cut(signatures(docs), "signatures")
    known = rows.where(F.col("set_key").isNotNull())
    # One representative a class: the row of its least id. Bands depend on the set alone.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("m")
    classes = known.groupBy("set_key").agg(least_row, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = cut(classes.select("set_key", "m.doc_id", "m.text_hash", "n", "bands", "rows"), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), F.col("set_key").alias("u"), F.col("n"))
    shared = cut(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    # A class has no more than BANDS buckets, which its row gathers beside the company in all of them.
    company = join_hot(banded, shared.withColumn("size", F.col("members")), ["bucket"], "size").groupBy("u", "n").agg(F.sum("members").alias("company"), F.collect_list("bucket").alias("buckets"))
    company = cut(company.select(F.explode("buckets").alias("bucket"), "u", "n", "company"), "company")
    hubs = cut(company.groupBy("bucket").agg(F.max(F.struct("company", "u", "n")).alias("hub"), F.count("*").alias("size")).select("bucket", F.col("hub.u").alias("v"), F.col("hub.n").alias("m"), "size"), "hubs")
    # Members of buckets with company; all later steps work on these.
    members = cut(join_hot(company, hubs, ["bucket"], "size").select("bucket", "u", "n", "v", "m"), "members")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT  # sets of too different sizes cannot be alike enough
    stars = cut(members.where((F.col("u") != F.col("v")) & near).select("u", "v").distinct(), "stars")
    links = _confirm(stars, classes, docs)
    roots = components(links)
    # What is left: in buckets over several components, those outside the largest against all of another component.
    placed = members.join(roots.withColumnRenamed("node", "u"), "u", "left").select("bucket", "u", "n", F.coalesce("root", "u").alias("root"))
    placed = cut(placed, "placed")
    by_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    mixed = by_root.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots"), F.min("least").alias("least"), F.sum("size").alias("size"))
    mixed = cut(mixed.where("roots > 1").select("bucket", F.col("top.root").alias("top"), "least", "size"), "mixed-buckets")
    placed = cut(join_hot(placed, mixed, ["bucket"], "size"), "mixed")
    # A link of sets of n and m shingles needs PERCENT / (100 + PERCENT) of n + m in both, so no fewer than that among
    # those that they may share. Sets that have too few for the smallest possible partner make no pairs by buckets.
    rare = _rare_shingles(_texts(placed.select(F.col("u").alias("set_key")).distinct(), classes, docs))
    lost = rare.select(F.explode("sets").alias("u"), "rare").groupBy("u").agg(F.sum("rare").alias("lost"))
    placed = cut(placed.join(lost, "u", "left").withColumn("most", (F.col("n") - F.coalesce("lost", F.lit(0))) * (100 + PERCENT)), "bounded")
    able = placed.where(F.col("most") >= (F.col("n") + F.greatest("least", F.col("n") * PERCENT / 100)) * PERCENT)
    able = able.groupBy("u", "n", "root", "most").agg(F.collect_list(F.struct("bucket", "top")).alias("in"), F.collect_list("bucket").alias("buckets"))  # BANDS at most
    able = cut(able.select("u", "n", "root", "most", "buckets", F.explode("in").alias("in")).select("u", "n", "root", "most", "buckets", "in.*"), "able")
    minor = able.where(F.col("root") != F.col("top")).select("bucket", "u", "n", "root", "most", "buckets")
    theirs = [F.col("u").alias("v"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("most").alias("other_most")]
    others = able.select("bucket", *theirs, F.col("buckets").alias("other_buckets"), (F.col("root") == F.col("top")).alias("is_top"))
    apart, enough = F.col("root") != F.col("other"), (F.col("n") + F.col("m")) * PERCENT
    once = F.col("bucket") == F.array_min(F.array_intersect("buckets", "other_buckets"))  # of all buckets that a pair shares, one makes it
    rest = minor.join(others, "bucket").where(apart & (F.col("is_top") | (F.col("u") < F.col("v"))) & near & (F.least("most", "other_most") >= enough) & once)
    sets = placed.select("u", "n", "root", "most").distinct()
    # Pairs with rare shingles in common, if they are of different components.
    few = rare.where(F.size("sets") > 1).select(F.monotonically_increasing_id().alias("id"), "sets", "rare")
    few = cut(few, "few-sets").select("id", "rare", F.explode("sets").alias("u")).join(sets, "u").groupBy("id", "rare").agg(F.collect_list(F.struct("u", "n", "root", "most")).alias("sets"), F.count_distinct("root").alias("roots"))
    few = few.where("roots > 1").select("id", "rare", "sets", F.explode("sets").alias("a")).select("rare", "a", F.explode("sets").alias("b"))
    few = few.where((F.col("a.u") < F.col("b.u")) & (F.col("a.root") != F.col("b.root"))).groupBy("a", "b").agg(F.sum("rare").alias("rare"))
    few = few.select("a.*", "rare", *[F.col(f"b.{x}").alias(y) for x, y in (("u", "v"), ("n", "m"), ("root", "other"), ("most", "other_most"))])
    pair = ["u", "v", "root", "other"]
    rest = rest.select(*pair).union(few.where(near & (F.least("most", "other_most") + F.col("rare") * (100 + PERCENT) >= enough)).select(*pair))
    ordered = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    rest = rest.select(*ordered, "root", "other").dropDuplicates(["u", "v"]).join(stars.select(*ordered), ["u", "v"], "left_anti")
    more = _confirm(cut(rest, "rest"), classes, docs)
    if more.limit(1).count():  # the groups found so far are linked by their roots
        roots = components(roots.toDF("u", "v").union(more.select("root", "other")))

    grouped = classes.select("set_key", "doc_id", "rows").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    grouped = cut(grouped, "grouped")
    least = cut(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), "roots")
    of_set = cut(join_hot(grouped, least, ["root"], "size").select("set_key", "component_id", "root", "rows"), "of-sets")
    out = join_hot(known.select("doc_id", "text_hash", "n_shingles", "set_key"), of_set, ["set_key"], "rows").select("doc_id", "text_hash", "n_shingles", "component_id", "root")
    empty = rows.where(F.col("set_key").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root"))
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
