"""Operator 6: a byte-level convolutional network in numpy that scores a document's quality.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk's byte
embeddings; each filter's largest response in a chunk is its feature there (max-pooling). A document's features are
the mean and the maximum of its chunks' features, and a logistic unit combines them into one probability.

The network is trained here, by Adam on a bounded sample of labelled documents (``max_labelled`` documents, chosen by a
hash of their id, each of them whole, however long); scoring is one pass over whole texts on the executors and shuffles
nothing. Chunks are laid out some thousand at a time: beside its text, a document costs the pooled features of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spare, spread
from .text import byte_data, lengths_to_rows, ragged, slices, strings

CHUNK, HOP = 256, 224
WIDTH, STRIDE = 8, 4
EMBED, FILTERS = 8, 32
PAD = 256
#: Bound of the training sample, in documents.
MAX_LABELLED = 3000
BLOCK = 2048


class Chunks:
    """Overlapping chunks of texts that lie one after the other in ``data`` (bytes, text i from offsets[i] to offsets[i + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data if len(data) else np.zeros(1, np.uint8)
        sizes = np.diff(offsets)
        self.counts = 1 + np.maximum(0, -(-(sizes - CHUNK) // HOP))
        self.starts = np.repeat(offsets[:-1], self.counts) + ragged(np.zeros(len(sizes), np.int64), self.counts) * HOP
        self.ends = np.repeat(offsets[1:], self.counts)

    @staticmethod
    def of(texts: list[bytes]) -> Chunks:
        return Chunks(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts)

    def cells(self, chunk: np.ndarray | slice, at: np.ndarray) -> np.ndarray:
        """Byte numbers at places ``at`` of these chunks; PAD beyond a text's end."""
        place = self.starts[chunk][:, None] + at
        return np.where(place < self.ends[chunk][:, None], self.data[np.minimum(place, len(self.data) - 1)].astype(np.int16), np.int16(PAD))

    def rows(self, start: int, end: int) -> np.ndarray:
        return self.cells(slice(start, end), np.arange(CHUNK))


@dataclass
class ByteNet:
    seed: int = 5
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            r = np.random.default_rng(self.seed)
            self.p = {
                "embed": r.normal(0, 0.5, (257, EMBED)), "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
                "bias": np.zeros(FILTERS), "out": r.normal(0, 0.1, 2 * FILTERS), "offset": np.zeros(1),
            }
            self.p["embed"][PAD] = 0
            self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk, and where it lies."""
        e = np.ascontiguousarray(self.p["embed"][rows])
        places = (CHUNK - WIDTH) // STRIDE + 1
        windows = np.lib.stride_tricks.as_strided(e, (len(rows), places, WIDTH * EMBED), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
        r = (windows.reshape(-1, WIDTH * EMBED) @ self.p["filters"]).reshape(len(rows), places, FILTERS)
        best = r.argmax(axis=1)
        return np.maximum(np.take_along_axis(r, best[:, None], axis=1)[:, 0] + self.p["bias"], 0), best

    def logits(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(features, starts, axis=0) / counts[:, None]
        top = np.maximum.reduceat(features, starts, axis=0)
        return mean @ self.p["out"][:FILTERS] + top @ self.p["out"][FILTERS:] + self.p["offset"], mean, top

    def pooled(self, parts: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """``responses`` of all chunks, made a block at a time."""
        features, best = np.empty((len(parts), FILTERS), np.float32), np.empty((len(parts), FILTERS), np.uint8)
        for i in range(0, len(parts), BLOCK):
            features[i : i + BLOCK], best[i : i + BLOCK] = self.responses(parts.rows(i, i + BLOCK))
        return features, best

    def scores(self, texts: list[bytes] | Chunks) -> np.ndarray:
        parts = texts if isinstance(texts, Chunks) else Chunks.of(texts)
        if not len(parts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.logits(self.pooled(parts)[0], parts.counts)[0].astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        parts = Chunks.of(texts)
        counts = parts.counts
        features, best = self.pooled(parts)
        z, mean, top = self.logits(features, counts)
        d = ((1 / (1 + np.exp(-z)) - y) * weight / weight.sum()).astype(np.float32)
        doc = lengths_to_rows(counts)
        out = self.p["out"]
        is_top = (features == top[doc]).astype(np.float32)
        is_top /= np.add.reduceat(is_top, np.cumsum(counts) - counts, axis=0)[doc]  # equal chunks share the pull
        df = d[doc, None] * (out[:FILTERS] / counts[doc, None] + out[FILTERS:] * is_top)
        df = (df * (features > 0)).astype(np.float32)
        # Only the windows that won the pooling carry gradient.
        chunk, f = np.nonzero(df)
        g = df[chunk, f]
        won = parts.cells(chunk, best[chunk, f].astype(np.int64)[:, None] * STRIDE + np.arange(WIDTH))
        inputs = self.p["embed"][won].reshape(len(chunk), -1)
        gf = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
        order = np.argsort(f, kind="stable")
        present, first = np.unique(f[order], return_index=True)
        if len(order):
            gf[present] = np.add.reduceat((inputs * g[:, None])[order], first, axis=0)
        de = (g[:, None] * self.p["filters"].T[f]).reshape(-1, EMBED)
        ge = np.stack([np.bincount(won.ravel(), weights=de[:, k], minlength=257) for k in range(EMBED)], axis=1)
        ge[PAD] = 0
        return {"embed": ge, "filters": gf.T, "bias": df.sum(axis=0), "out": np.concatenate([d @ mean, d @ top]), "offset": d.sum(keepdims=True)}

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, least_steps: int = 300, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> ByteNet:
        """Adam over shuffled batches with a falling rate, classes weighted to count alike; more epochs over small samples.

        Deterministic for a given sample.
        """
        y = labels.astype(np.float32)
        if len(y) == 0:
            return self
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** 0.5
        r, m, v, t = np.random.default_rng(self.seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        epochs = min(60, max(epochs, least_steps // -(-len(y) // batch)))
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                some, t = order[at : at + batch], t + 1
                step = rate * (1 - (t - 1) / total)
                for k, g in self.gradients([texts[i] for i in some], y[some], weight[some]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7) + decay * self.p[k])).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is held out of nothing and labelled by nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_labelled: int) -> tuple[pa.LargeStringArray, np.ndarray]:
    """At most ``max_labelled`` labelled texts, whole, chosen by a hash of the id, in a fixed order."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.join(texts, "doc_id").select("doc_id", "y", "text").orderBy("doc_id", "text").limit(max_labelled).select("y", "text").toArrow()
    return rows.column("text").cast(pa.large_string()).combine_chunks(), rows.column("y").to_numpy().astype(np.int64)


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ByteNet:
    """The network for these labels; without any it is untrained, and still scores."""
    texts, y = training_sample(docs, labels, "quality", ~held_out(F.col("doc_id")), max_labelled)
    return ByteNet().train(texts.cast(pa.large_binary()).to_pylist(), y)


def score_quality(docs: DataFrame, net: ByteNet, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``score`` (with underscores after it if a kept column has that name).

    Only the text's bytes are read; a null or empty text has one chunk of padding and its score. One row per input row,
    repeated rows alike; an empty table gives no rows. Very long texts are scored whole.
    """
    keep = docs.columns if keep is None else keep
    column, score = spare(docs, "_scored_text"), spare(docs.select(*keep), "score")
    read = docs.select(*keep, F.col("text").alias(column))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(p=shared.value)
        for batch in slices(batches, column, 512 << 10):
            parts = Chunks(*byte_data(strings(batch, column)))
            yield pa.record_batch([*batch.columns[:-1], pa.array(own.scores(parts), pa.float64())], names=[*keep, score])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema.fields[:-1]) + f"`{score}` double"
    return read.mapInArrow(run, schema)


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score_quality(spread(docs), net, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
