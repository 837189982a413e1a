"""Words of whole texts as flat numpy arrays, and the hashes made from them. Used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with nulls as empty strings, in memory of its own: Arrow's case functions misread slices of others."""
    found = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    return found.take(pa.array(np.arange(len(found))))


def byte_data(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and offsets; ``texts`` as :func:`strings` gives them. Nothing is copied."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches between rows so that each holds about ``limit`` bytes of text (one longer text stays whole)."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns ``offsets`` (text i has the words offsets[i] to offsets[i + 1]), ``codes`` (for each word its place in the
    vocabulary) and the vocabulary (distinct words). ``lower`` lower-cases A-Z only.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = np.asarray(pc.list_value_length(parts), np.int64)
    flat = parts.flatten()
    real = np.asarray(pc.binary_length(flat), np.int64) > 0
    bounds = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], np.cumsum(real)])[bounds]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each vocabulary entry that is the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w, seed) for w in vocabulary.cast(pa.large_binary()).to_pylist()], np.uint64)


def lengths_to_rows(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + counts, counts)
