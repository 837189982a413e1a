"""Operator 1: URL filter. A blocked Bloom filter passes possible hits to an exact hash join.

The list holds canonical URLs ``host/path``; an entry fits its host and every subdomain, for paths that start with
its path, and the longest fitting entry gives the verdict. Inside the scan the Bloom filter first drops host suffixes
under which nothing is listed; for the others the keys that could be listed are formed (suffixes times the path lengths
that the list has), the filter drops nearly all of them, and what is left is joined exactly with the list, which removes
false positives. Rows of hot keys (``net/`` fits a large part of all URLs) and of hot URLs are joined where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, join_hot
from .text import mix

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts that are known for spam; they are blocked where no rule says otherwise.
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "ads-track.example.com")
BLOCK_WORDS = 8  # 64-bit words in a block: one cache line
PROBES = 8
#: Code points of a listed path, without its slash, from which an entry is joined by itself and not through the filter.
LONG = 2048
#: Rows from which a URL is looked at as hot, whether or not it is listed.
OFTEN = 500


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


class BlockedBloom:
    """Bits in blocks of 512: one hash picks the block, the bits of another the places in it.

    ``max_mb`` bounds what is broadcast. A longer list than the bits are meant for raises the share of false
    positives, which the exact join removes; no listed key is ever missed.
    """

    def __init__(self, n_keys: int, bits_per_key: int = 12, max_mb: int = 16):
        blocks = 1 << max(0, math.ceil(math.log2(max(1, n_keys * bits_per_key / (64 * BLOCK_WORDS)))))
        self.words = np.zeros((min(blocks, max_mb * (1 << 20) // (8 * BLOCK_WORDS)), BLOCK_WORDS), np.uint64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = (mix(hashes) >> np.uint64(32)) % np.uint64(len(self.words))
        bits = (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(7))) & np.uint64(511)
        # The seven-bit steps overlap in their upper bits; scrambling each with its number keeps the probes apart.
        bits = mix(bits + (hashes[:, None] | np.uint64(1)) * (np.arange(PROBES, dtype=np.uint64) + np.uint64(1))) & np.uint64(511)
        return block.astype(np.int64)[:, None], (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))

    def set_bits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, mask) of every bit that these keys set."""
        block, word, mask = self._places(hashes)
        return (block * BLOCK_WORDS + word).ravel(), mask.ravel()

    def might_have(self, hashes: np.ndarray) -> np.ndarray:
        block, word, mask = self._places(hashes)
        return ((self.words[block, word] & mask) == mask).all(axis=1)


def hashes_of(keys: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys.cast(pa.large_binary()).to_pylist()], np.uint64)


def is_long() -> Column:
    return F.length("key") - F.instr("key", "/") >= LONG


def long_hits(urls: DataFrame, listed: DataFrame, deepest: int) -> DataFrame:
    """(url, n, key, entry) for the long entries: an equi-join on host suffix and the path's first code points, exact."""
    cut_at = F.instr("key", "/")
    entries = listed.where(is_long()).select("key", "entry", F.substr(F.col("key"), F.lit(1), cut_at - 1).alias("_host"), F.substr(F.col("key"), cut_at).alias("_listed"))
    entries = entries.withColumn("_start", F.substring("_listed", 1, LONG + 1))
    labels = F.split("host", r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = urls.where(F.length("path") > LONG).select("url", "n", "path", F.substring("path", 1, LONG + 1).alias("_start"), F.explode(suffixes).alias("_host"))
    return near.join(entries, ["_host", "_start"]).where(F.startswith("path", "_listed")).select("url", "n", "key", "entry")


def build_filter(listed: DataFrame, max_mb: int = 16) -> tuple[BlockedBloom, list[int]]:
    """The filter over ``listed.key`` and the keys' hosts, and the distinct lengths (in code points) of the listed paths.

    Executors turn keys into bits and OR them; only the filter's words (at most ``max_mb``) and the path lengths (at
    most 2048: longer entries are left to ``long_hits``) come to the driver.
    """
    keys = listed.select("key").where(~is_long())
    every = keys.union(keys.select(F.substring_index("key", "/", 1)).distinct())  # a key has a slash, a host has none
    bloom = BlockedBloom(every.count(), max_mb=max_mb)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = bloom.set_bits(hashes_of(batch.column(0)))
            yield pa.record_batch([pa.array(word, pa.int64()), pa.array(mask.view(np.int64))], names=["word", "mask"])

    words = every.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bloom.words.reshape(-1)[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    lengths = keys.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().collect()
    return bloom, sorted(r["n"] for r in lengths)


def host_suffixes(hosts: set[str], bloom: BlockedBloom, deepest: int) -> dict[str, list[str]]:
    """The suffixes at dots, of at most ``deepest`` labels, under which the filter may have an entry, by host."""
    pairs = []
    for host in hosts:
        suffix = None
        for label in reversed(host.rsplit(".", deepest)[-deepest:]):
            suffix = label if suffix is None else f"{label}.{suffix}"
            pairs.append((host, suffix))
    out: dict[str, list[str]] = {host: [] for host in hosts}
    if pairs:
        hit = bloom.might_have(hashes_of(pa.array([s for _, s in pairs], pa.string())))
        for i in np.flatnonzero(hit).tolist():
            out[pairs[i][0]].append(pairs[i][1])
    return out


def candidate_keys(hosts: list[str], paths: list[str], lengths: list[int], suffixes: dict[str, list[str]]) -> tuple[np.ndarray, list[str]]:
    """For each row the listed keys that would fit it: its host's ``suffixes`` times path prefixes of listed lengths."""
    rows, keys = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        if own := suffixes[host]:
            prefixes = [path[:n] for n in lengths if n <= len(path)]
            keys += [suffix + p for suffix in own for p in prefixes]
            rows += [i] * (len(own) * len(prefixes))
    return np.array(rows, np.int64), keys


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, ``listed_key`` (the entry that decides, or null), its ``priority``, and ``verdict``.

    ``listed`` has (key, verdict, priority): of the entries that fit a URL, those of the highest priority count, and of
    them the longest. A key listed twice keeps the later verdict in the alphabet (``block`` after ``allow``). The list is
    joined with distinct URLs, so one URL that fills a third of the table costs one row there, and its rows stay where
    they are when they get their verdict. A null URL, or one without
    ``://``, has empty host and path, fits nothing and gets the default. One row per input row; extra columns are left
    out. A key without ``/`` raises.
    """
    listed = listed.groupBy("key").agg(F.max(F.struct("priority", "verdict")).alias("entry"))
    depth = F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))
    odd = listed.agg(F.count_if(~F.coalesce(F.col("key").contains("/"), F.lit(False))).alias("bad"), F.count_if(is_long()).alias("long"), F.max(depth).alias("deepest")).first()
    if odd["bad"]:
        raise ValueError(f"{odd['bad']} listed keys have no /")
    deepest = odd["deepest"] or 1
    bloom, lengths = build_filter(listed)
    shared = pages.sparkSession.sparkContext.broadcast((bloom, lengths))  # bounded by max_mb and 2048 lengths

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, lengths = shared.value
        for batch in batches:
            hosts = batch.column(1).to_pylist()
            rows, keys = candidate_keys(hosts, batch.column(2).to_pylist(), lengths, host_suffixes(set(hosts), bloom, deepest))
            found = pa.array(keys, pa.string())
            hit = bloom.might_have(hashes_of(found)) if keys else np.zeros(0, bool)
            rows = np.concatenate([rows[hit], np.flatnonzero(batch.column(3).to_numpy() > OFTEN)])
            keys = pa.concat_arrays([found.filter(pa.array(hit)), pa.nulls(len(rows) - int(hit.sum()), pa.string())])
            yield pa.record_batch([pc.take(batch.column(0), pa.array(rows)), pc.take(batch.column(3), pa.array(rows)), keys], names=["url", "n", "key"])

    host, path = host_path(F.col("url"))
    counted = pages.select("url").where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"))
    urls = counted.select("url", host.alias("host"), path.alias("path"), "n")
    likely = cut(urls.mapInArrow(hits, "url string, n long, key string"), "url-hits")
    named = cut(likely.groupBy("key").agg(F.count("*").alias("rows")).join(listed, "key"), "url-keys")
    exact = join_hot(likely, named, ["key"], "rows").select("url", "n", "key", "entry")
    often = likely.where("key IS NULL").select("url", "n", "key", F.lit(None).cast(exact.schema["entry"].dataType).alias("entry"))
    exact = exact.union(often)
    if odd["long"]:
        exact = exact.union(long_hits(urls, listed, deepest))
    fit = F.struct(F.col("entry.priority").alias("priority"), F.length("key").alias("n"), F.col("key"), F.col("entry.verdict").alias("verdict"))
    best = cut(exact.groupBy("url", "n").agg(F.max(F.when(F.col("entry").isNotNull(), fit)).alias("best")), "url-verdicts")
    mine = pages.select("page_id", "url")
    # ``best`` grows with the pages: only its hot rows are broadcast, whatever size its files have.
    judged = join_hot(mine.where("url IS NOT NULL"), best.hint("merge"), ["url"], "n", floor=OFTEN, how="left")
    judged = judged.unionByName(mine.where("url IS NULL").withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return judged.select(
        "page_id", "url", host.alias("host"), path.alias("path"), F.col("best.key").alias("listed_key"), F.col("best.priority").alias("priority"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules, and below them the spam hosts, are the list; ``rule`` is null where a spam host or none decides."""
    entries = [(k, v, 1) for k, v in RULES] + [(f"{h}/", "block", 0) for h in BLOCKED_HOSTS]
    listed = spark.createDataFrame(entries, "key string, verdict string, priority int")
    rows = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)
    return rows.select("page_id", "host", "path", F.when(F.col("priority") == 1, F.col("listed_key")).alias("rule"), "verdict")


OP1_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN starts_with(path, '/') AND regexp_matches(host, '(^|[.])(spam-farm[.]example[.]org|cheap-pills[.]example[.]com|ads-track[.]example[.]com)$') THEN 'block'
    ELSE 'allow' END AS verdict FROM judged
"""
