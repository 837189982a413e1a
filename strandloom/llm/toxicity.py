"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words; a document's is the
noisy-or of its sentences, 1 - prod(1 - p): one offending sentence is enough. Only documents are labelled: the gradient
of the noisy-or tells the sentences of a toxic document apart, so that the trained sentence scores locate the offence.

A document's worst sentence counts in full, any other only by what its score has above FLOOR: however many harmless
sentences a text has, they do not add up. Training keeps the small scores in, as they are what it starts from.

Training runs on a bounded sample of labelled documents, each of them whole; scoring is one pass over whole texts and
shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_cnn import training_sample
from .shared import spread
from .text import lengths_to_rows, slices, split_words, strings, word_hashes

BITS = 18
#: Bound of the training sample, in documents.
MAX_LABELLED = 12_000
#: Logit of a sentence in which nothing is known.
START = -9.0
#: Scores up to here, but for the worst sentence's, count as 0 in a document's score; those above are spread over 0 to 1.
FLOOR = 0.02
ENDS = "[.!?\n]"


def features(vocabulary: pa.Array) -> np.ndarray:
    """Three feature numbers a word: itself, its first five and its first four characters (for its inflected forms)."""
    forms = [vocabulary, *(pc.utf8_slice_codeunits(vocabulary, 0, n) for n in (5, 4))]
    return np.stack([(word_hashes(w, seed) >> np.uint64(64 - BITS)).astype(np.int64) for seed, w in enumerate(forms)], axis=1)


def sentence_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of every sentence.

    Sentences end at ``.``, ``!``, ``?`` or a line's end. Returns the sentences of each text (offsets), the features of
    each sentence (offsets), the feature numbers, and each sentence's length in bytes with its end mark. Words are
    lower-cased and freed of punctuation.
    """
    cutup = pc.split_pattern_regex(texts, ENDS)
    sentences = cutup.flatten()
    n = np.asarray(pc.list_value_length(cutup), np.int64)
    sizes = np.asarray(pc.binary_length(sentences), np.int64) + 1
    plain = pc.replace_substring_regex(pc.utf8_lower(sentences), r"[\x00-\x26\x28-\x2f:;<=>@\[\\\]^_`{|}~]+", " ")
    offsets, codes, vocabulary = split_words(plain)
    found = features(vocabulary)[codes].ravel() if len(vocabulary) else codes
    return np.concatenate([[0], np.cumsum(n)]), 3 * offsets, found, sizes


class SentenceModel:
    def __init__(self, weights: np.ndarray | None = None, bias: float = START):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.bias = bias

    def sentence_logits(self, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[words].astype(np.float64))])
        return np.clip(np.where(offsets[1:] > offsets[:-1], total[offsets[1:]] - total[offsets[:-1]] + self.bias, -30), -30, 30)

    @staticmethod
    def noisy_or(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kept = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
        return -np.expm1(kept[offsets[1:]] - kept[offsets[:-1]])

    @classmethod
    def document_scores(cls, p: np.ndarray, offsets: np.ndarray, floor: float = FLOOR) -> np.ndarray:
        """The noisy-or of each text's worst sentence, in full, and of what the others have above the floor."""
        counted = np.maximum(0, p - floor) / (1 - floor)
        if len(offsets) > 1:
            order = np.lexsort((-p, lengths_to_rows(np.diff(offsets))))
            worst = order[offsets[:-1]]  # every text has a sentence
            counted[worst] = p[worst]
        return cls.noisy_or(counted, offsets)

    def train(self, texts: pa.LargeStringArray, labels: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.5, l1: float = 0.02, least: int = 4, seed: int = 8) -> SentenceModel:
        """Adagrad with a soft threshold that keeps rare words at zero; five passes at least, more over small samples.

        Deterministic for a given sample.
        """
        if not len(labels):
            return self
        parts, in_docs = [], np.zeros(1 << BITS, np.int64)
        for start in range(0, len(texts), 500):
            d, s, w, _ = sentence_bags(texts.slice(start, 500).take(pa.array(np.arange(min(500, len(texts) - start)))))
            of = np.repeat(lengths_to_rows(np.diff(d)), np.diff(s))
            in_docs += np.bincount(np.unique(w * 500 + of) // 500, minlength=1 << BITS)
            parts.append((np.diff(d), np.diff(s), w.astype(np.int32)))
        # What stands in fewer than ``least`` documents says nothing about others.
        doc_at, sent_at = (np.concatenate([[0], np.cumsum(np.concatenate([p[k] for p in parts]))]) for k in (0, 1))
        words = np.concatenate([p[2] for p in parts])
        usable = (in_docs >= least).astype(np.float32)
        y = labels.astype(np.float64)
        r, seen = np.random.default_rng(seed), np.full(1 << BITS, 0.1)
        n_batches = -(-len(labels) // batch)
        for _ in range(min(60, max(5, steps // n_batches))):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = np.sort(order[at : at + batch])
                n_s = doc_at[docs + 1] - doc_at[docs]
                sents = np.repeat(doc_at[docs] - np.cumsum(n_s) + n_s, n_s) + np.arange(n_s.sum())
                n_w = sent_at[sents + 1] - sent_at[sents]
                pos = np.repeat(sent_at[sents] - np.cumsum(n_w) + n_w, n_w) + np.arange(n_w.sum())
                ids, s_off, d_off = words[pos], np.concatenate([[0], np.cumsum(n_w)]), np.concatenate([[0], np.cumsum(n_s)])
                p = 1 / (1 + np.exp(-self.sentence_logits(s_off, ids)))
                whole = np.clip(self.noisy_or(p, d_off), 1e-7, 1 - 1e-7)
                pull = np.where(y[docs] == 1, -(1 - whole) / whole, 1.0)
                g = pull[lengths_to_rows(n_s)] * p  # of each sentence's logit
                some, place = np.unique(ids, return_inverse=True)
                gw = np.bincount(place, weights=np.repeat(g, n_w), minlength=len(some))
                seen[some] += gw * gw
                step = rate / np.sqrt(seen[some])
                moved = self.weights[some] - step * gw
                self.weights[some] = (np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0) * usable[some]).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> SentenceModel:
    """The model for these labels; without any every sentence is harmless."""
    return SentenceModel().train(*training_sample(docs, labels, "toxic", ~held_out(F.col("doc_id")), max_labelled))


def score_toxicity(docs: DataFrame, model: SentenceModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, n_toxic, worst_start, worst_bytes, worst_score).

    ``worst_*`` give the most offending sentence: the byte where it starts in the text's UTF-8 form, its length with
    its end mark, its own score. A null text is an empty one: one empty sentence. One row per input row,
    repeated rows alike; extra columns are ignored; an empty table gives no rows. Very long texts are scored whole, and
    harmless sentences never add up to a toxic text.
    """
    weights = model.weights
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], model.bias))  # at most 2^18 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias = shared.value
        own = SentenceModel(bias=bias)
        own.weights[used] = values
        for batch in slices(batches, "text"):
            doc_at, sent_at, words, sizes = sentence_bags(strings(batch, "text"))
            p = 1 / (1 + np.exp(-own.sentence_logits(sent_at, words)))
            n = np.diff(doc_at)
            doc, begins = lengths_to_rows(n), np.cumsum(sizes) - sizes
            order = np.lexsort((np.arange(len(p)), -p, doc))
            worst = order[doc_at[:-1]]
            toxic = np.bincount(doc, weights=p >= threshold, minlength=len(n)).astype(np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(own.document_scores(p, doc_at)), pa.array(n), pa.array(toxic), pa.array(begins[worst] - begins[doc_at[:-1]]), pa.array(sizes[worst]), pa.array(p[worst])],
                names=["doc_id", "score", "n_sentences", "n_toxic", "worst_start", "worst_bytes", "worst_score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_sentences long, n_toxic long, worst_start long, worst_bytes long, worst_score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = score_toxicity(spread(docs), train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_bytes", "worst_score")
