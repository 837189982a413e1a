"""Operator 7: best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Bounded-space online best-fit: pieces are placed for good in the order in which they come. A fixed number of bins is
open at a time, held by their free space with a bitset over the free spaces in use. A piece goes to the open bin with
the least free space that holds it; where none does, a bin is opened, and if too many are open the fullest closes first.
Pieces of full length are sequences of their own.

Rows are dealt over packers of some ``rows_per_packer`` each; a packer sees its pieces in the order of the written table
of pieces and holds its open bins only: a lost executor's packers are run again with the same result, and no packer
grows with the input.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenizer_files
from .shared import cut, spare, spread
from .text import ragged, slices, split_words, strings

CAPACITY, OPEN_BINS, ROWS_PER_PACKER = 4096, 256, 50_000
CACHE_WORDS = 400_000


#: Parts of a tokenizer file for which a text's ids are those of its words in order, whatever the case of A-Z. Fixed
#: values: they are compared with the file's.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space before it merges anything, and cuts between letters and marks."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return norm.get("normalizers") == NORMALIZERS and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)


class WordTokens:
    """Token ids of texts.

    Where the tokenizer's file says that its tokens never cross white space (see :func:`splits_at_blanks`), a text's ids
    are the ids of its words in order, and each distinct word is encoded once by the library, in lists. It lower-cases
    too, and cuts between an ASCII letter and a full stop or comma; doing both first leaves fewer distinct words. Texts
    that spell an added token, in whatever case, are left as they are. With any other file whole texts are encoded.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_blanks(spec)
        self.added = "(?i)" + "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"])
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts, self.counts, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, words: list[str]) -> None:
        ids, owners = [], []
        for at in range(0, len(words), 2000):
            some = self.tokenizer.encode(words[at : at + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(some.ids, np.int32))
            owners.append(np.array(some.word_ids, np.int64) + at)
        counts = np.bincount(np.concatenate(owners), minlength=len(words)) if ids else np.zeros(0, np.int64)
        base = len(self.counts)
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.tokens = np.concatenate([self.tokens, *ids])
        self.memo.update(zip(words, range(base, base + len(words)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and offsets."""
        if not self.by_word:
            whole = [np.array([*e.ids, end_id], np.int32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *whole]), np.concatenate([[0], np.cumsum([len(w) for w in whole])]).astype(np.int64)
        if len(self.memo) > CACHE_WORDS:
            self.reset()
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,]\s)", r"\1 \2")
        if self.added != "(?i)":
            plain = pc.if_else(pc.match_substring_regex(texts, self.added), texts, plain)
        offsets, codes, vocabulary = split_words(plain)
        words = vocabulary.to_pylist()
        if new := [w for w in words if w not in self.memo]:
            self._add(new)
        units = np.array([self.memo[w] for w in words], np.int64)[codes] if words else codes
        sizes = self.counts[units]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets] + np.arange(len(offsets))
        ids = np.full(int(ends[-1]), end_id, np.int32)
        inner = np.ones(len(ids), bool)
        inner[ends[1:] - 1] = False
        ids[inner] = self.tokens[ragged(self.starts[units], sizes)]
        return ids, ends


_tokens: dict[str, WordTokens] = {}


def word_tokens(tokenizer_file: str) -> WordTokens:
    if tokenizer_file not in _tokens:
        _tokens[tokenizer_file] = WordTokens(tokenizer_file)
    return _tokens[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens, cut where longer than ``capacity``.

    A null or blank text has the end id alone. One or more rows per input row, for repeated rows and null ids too; extra
    columns are ignored; an empty table gives no rows. A very long text is encoded by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_file)
        for batch in slices(batches, "text", 8 << 20):
            ids, ends = tokens.encode(strings(batch, "text"), end_id)
            totals = np.diff(ends)
            n = -(-totals // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = ragged(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(capacity, totals[doc] - start)
            at = ends[doc] + start
            raw, lo, hi = ids.astype("<u4").tobytes(), (4 * at).tolist(), (4 * (at + length)).tolist()
            view = memoryview(raw)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(lo, hi, strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(ids)))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenBins:
    """The open bins by free space. ``bits`` has bit f set where a bin with f tokens free is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.n_open, self.n_made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this length."""
        if length >= self.capacity:
            self.n_made += 1
            return self.n_made - 1, 0
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length  # the least free space that is enough
            number = self._take(free)
        else:
            if self.n_open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.n_made
            self.n_made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.n_open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rows_per_packer: int = ROWS_PER_PACKER) -> DataFrame:
    """Adds sequence_id and offset (with underscores after a name that is taken) to rows with ``length``.

    Any table of pieces will do, with nulls and repeated rows in its other columns: each row is placed by itself. A
    null or negative length raises; an empty table gives no rows. Rows longer than ``capacity`` are no pieces: cut them
    before (see :func:`pieces`).
    """
    n = F.col("length")
    parts = cut(parts.withColumn("length", F.when(n.isNull() | (n < 0), F.raise_error(F.lit("a piece needs a length"))).otherwise(n)), "packing-pieces")
    names = parts.columns
    at, packer, arrival = names.index("length"), spare(parts, "packer"), spare(parts, "arrival")
    added = [spare(parts, c) for c in ("sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, current = OpenBins(capacity, open_bins), None
        for batch in batches:
            number, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, (group, length) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(at).to_pylist(), strict=True)):
                if group != current:
                    bins, current = OpenBins(capacity, open_bins), group
                number[i], offset[i] = bins.place(length)
                number[i] += group << 32
            yield pa.record_batch([*batch.columns[:-2], pa.array(number), pa.array(offset)], names=[*names, *added])

    # ``parts`` is a written table: a row's number in it, and so its packer, is the same in every attempt of a task.
    packers = -(-max(1, parts.count()) // rows_per_packer)
    dealt = parts.withColumn(arrival, F.monotonically_increasing_id())
    dealt = dealt.withColumn(packer, F.pmod(F.xxhash64(arrival), F.lit(packers))).select(*names, packer, arrival)
    dealt = dealt.repartition(packer).sortWithinPartitions(packer, arrival)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.schema.fields) + "`{}` long, `{}` long".format(*added)
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_files.path("word_bpe_49k.json"), with_ids=with_ids))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
