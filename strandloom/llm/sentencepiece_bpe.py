"""Operator 3: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words become one flat array of symbols. In every round each word's lowest pair rank is found, all
its leftmost occurrences are merged at once, and the arrays are compacted, until no pair is left. Long words are cut
first wherever two neighbouring characters stand together in no vocabulary entry: no merge can cross such a place.

Merging a word's occurrences at once equals merging them one by one unless a merge makes a pair that ranks as early as
the one merged. That is watched: such a word (runs of blanks, for example) is merged one pair at a time with a heap.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import tokenizer_files
from .shared import spread
from .text import lengths_to_rows, ragged, slices, strings

SPACE = "▁"
NONE = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHE_WORDS = 300_000
UNITS = re.compile(" *[^ ]+| +")


class PairTable:
    """Hash table from a pair of symbols to (rank, merged symbol), probed for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(8, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        self.probes = 1
        for (a, b), (rank, merged) in pairs.items():
            key = a << 32 | b
            at = self._slot(np.array([key], np.int64))[0]
            n = 1
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
                n += 1
            self.keys[at], self.rank[at], self.merged[at], self.probes = key, rank, merged, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        rank, merged = np.full(len(keys), NONE, np.int32), np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (seen != -1)
            if not on.any():
                break
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return rank, merged


class PieceModel:
    """A BPE model file with byte fallback, identity normalisation and a dummy prefix, as arrays."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        self.kinds = np.array([p.type for p in proto.pieces], np.int8)
        self.pieces = [p.piece for p in proto.pieces]
        self.n = len(self.pieces)
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        normal = {self.pieces[i]: int(i) for i in np.flatnonzero(self.kinds == NORMAL)}
        ranks = {s: r for r, s in enumerate(sorted({-proto.pieces[i].score for i in normal.values()}))}
        # Symbols: pieces by id; characters that are no pieces follow, those of pieces first, then any other by its code.
        extra: dict[str, int] = {}
        symbol = lambda s: normal.get(s, extra.get(s))
        for piece in normal:
            for c in piece:
                if c not in normal:
                    extra.setdefault(c, self.n + len(extra))
        self.base = self.n + len(extra)
        pairs, bigrams = {}, set()
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                bigrams.add((ord(piece[k - 1]), ord(piece[k])))
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (ranks[-proto.pieces[i].score], i)
        self.table = PairTable(pairs)
        self.joined = PairTable({b: (0, 0) for b in bigrams})
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + self.base
        for c, i in [(c, i) for c, i in normal.items() if len(c) == 1] + list(extra.items()):
            self.char_symbol[ord(c)] = i
        self.extra_chars = {i: c for c, i in extra.items()}
        texts = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.text_lengths = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.memo: dict[str, int] = {}
        self._reset()

    # ---- encoding

    def _merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of each owner (ascending numbers) to the end."""
        odd: list[tuple[int, list[int]]] = []
        done_s, done_o = [], []
        rank, merged = self._ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(starts, len(owner)))
            low = np.minimum.reduceat(rank, starts)
            if (low == NONE).any():  # compaction: finished words leave
                still = np.repeat(low != NONE, counts)
                done_s.append(symbols[~still])
                done_o.append(owner[~still])
                symbols, owner, rank, merged = symbols[still], owner[still], rank[still], merged[still]
                counts, low = counts[low != NONE], low[low != NONE]
                if not len(symbols):
                    break
            level = np.repeat(low, counts)
            at = np.flatnonzero(rank == level)
            # In a run of overlapping occurrences every other one is merged, from the left.
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            first = at[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))]
            at = at[(at - first[run]) % 2 == 0]
            before, before_owner = symbols, owner
            symbols = symbols.copy()
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            new = place[at]
            symbols, owner, level = symbols[keep], owner[keep], level[keep]
            rank, merged = rank[keep], merged[keep]
            mark = np.zeros(len(symbols), bool)
            mark[new] = mark[new[new > 0] - 1] = True
            touched = np.flatnonzero(mark)
            inner = touched[touched + 1 < len(symbols)]
            rank[touched], merged[touched] = NONE, -1
            same = inner[owner[inner] == owner[inner + 1]]
            rank[same], merged[same] = self.table.find(symbols[same], symbols[same + 1])
            # A new pair that ranks no later than what was merged: these words are taken out and merged one by one.
            early = same[rank[same] <= level[same]]
            if len(early):
                bad = np.unique(owner[early])
                ends = np.searchsorted(before_owner, bad, side="right")
                for o, a, b in zip(bad.tolist(), np.searchsorted(before_owner, bad).tolist(), ends.tolist(), strict=True):
                    odd.append((o, self._one_by_one(before[a:b].tolist())))
                ok = ~np.isin(owner, bad)
                symbols, owner, rank, merged = symbols[ok], owner[ok], rank[ok], merged[ok]
        done_s += [np.array(s, np.int32) for _, s in odd]
        done_o += [np.full(len(s), o, owner.dtype) for o, s in odd]
        if not done_s:
            return symbols, owner
        symbols, owner = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(symbols), NONE, np.int32), np.full(len(symbols), -1, np.int32)
        if len(symbols) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same], merged[same] = self.table.find(symbols[same], symbols[same + 1])
        return rank, merged

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The order of the definition: always the lowest rank, the leftmost of equals."""
        n = len(symbols)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, merged = (x.tolist() for x in self.table.find(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)))
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = symbols[i], symbols[j]
                if pair not in known:
                    r, m = self.table.find(np.array(pair[:1], np.int64), np.array(pair[1:], np.int64))
                    known[pair] = int(r[0]), int(m[0])
                r, m = known[pair]
                if r != NONE:
                    heapq.heappush(heap, (r, i, *pair, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, x in zip(symbols, live, strict=True) if x]

    def _add(self, units: list[str]) -> None:
        """Encodes units (words with their leading blanks as SPACE) and appends them to the tables of known ones."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(u) for u in units], np.int64)
        unit = lengths_to_rows(lengths)
        cut = np.ones(len(chars), bool)
        if len(chars) > 1:
            cut[1:] = (unit[1:] != unit[:-1]) | (self.joined.find(chars[:-1], chars[1:])[0] == NONE)
        symbols, owner = self._merge(self.char_symbol[chars], np.cumsum(cut) - 1)
        unit_of = unit[cut][owner] if len(owner) else owner
        ids, unit_of = self._fall_back(symbols, unit_of)
        counts = np.bincount(unit_of, minlength=len(units))
        base = len(self.counts)
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.tokens = np.concatenate([self.tokens, ids.astype(np.int32)])
        self.memo.update(zip(units, range(base, base + len(units)), strict=True))

    def _fall_back(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become the byte tokens of their UTF-8 form."""
        strange = np.flatnonzero(symbols >= self.n)
        if not len(strange):
            return symbols, unit
        spelled = {s: (self.extra_chars.get(s) or chr(s - self.base)).encode("utf-8", "surrogatepass") for s in np.unique(symbols[strange]).tolist()}
        counts = np.ones(len(symbols), np.int64)
        counts[strange] = [len(spelled[s]) for s in symbols[strange].tolist()]
        out = np.repeat(symbols, counts)
        at = ragged((np.cumsum(counts) - counts)[strange], counts[strange])
        out[at] = self.byte_ids[np.frombuffer(b"".join(spelled[s] for s in symbols[strange].tolist()), np.uint8)]
        return out, np.repeat(unit, counts)

    def _reset(self) -> None:
        self.memo.clear()
        self.starts, self.counts, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with begin and end ids, and offsets."""
        if len(self.memo) > CACHE_WORDS:
            self._reset()
        texts = pc.replace_substring(texts, SPACE, " ")  # to the model both are the same symbol
        parts = pc.split_pattern(texts, " ")
        counts = np.asarray(pc.list_value_length(parts), np.int64)
        flat = parts.flatten()
        empty = np.asarray(pc.binary_length(flat), np.int64) == 0
        text_of = lengths_to_rows(counts)
        plain = np.ones(len(texts), bool)
        plain[text_of[empty]] = False  # leading, trailing or double blanks, or no text at all
        coded = flat.filter(pa.array(plain[text_of])).dictionary_encode()
        words = [SPACE + w for w in coded.dictionary.to_pylist()]
        rare: list[list[str]] = []
        for i in np.flatnonzero(~plain).tolist():
            text = texts[i].as_py()
            rare.append([u.replace(" ", SPACE) for u in UNITS.findall(" " + text)] if text else [])
        units = dict.fromkeys(words)
        for row in rare:
            units.update(dict.fromkeys(row))
        if new := [u for u in units if u not in self.memo]:
            self._add(new)
        place = np.array([self.memo[w] for w in words], np.int64)
        n_units = np.where(plain, counts, 0)
        n_units[~plain] = [len(r) for r in rare]
        codes = np.empty(int(n_units.sum()), np.int64)
        from_plain = np.repeat(plain, n_units)
        codes[from_plain] = place[coded.indices.to_numpy(zero_copy_only=False)]
        codes[~from_plain] = [self.memo[u] for row in rare for u in row]
        sizes = self.counts[codes]
        totals = np.bincount(lengths_to_rows(n_units), weights=sizes, minlength=len(texts)).astype(np.int64) + 2
        offsets = np.concatenate([[0], np.cumsum(totals)])
        ids = np.empty(int(offsets[-1]), np.int32)
        inner = np.ones(len(ids), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        ids[offsets[:-1]], ids[offsets[1:] - 1] = self.bos, self.eos
        ids[inner] = self.tokens[ragged(self.starts[codes], sizes)]
        return ids, offsets

    # ---- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the id lists; control ids vanish, the dummy prefix goes, bytes that form no character become U+FFFD."""
        sizes = self.text_lengths[ids]
        data = self.text_bytes[ragged(self.text_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        out = []
        for i in range(len(offsets) - 1):
            raw = data[ends[i] : ends[i + 1]]
            seen = ids[offsets[i] : offsets[i + 1]]
            k = int(np.argmax(self.kinds[seen] != CONTROL)) if len(seen) else 0
            if len(raw) and self.kinds[seen[k]] == NORMAL and raw[:1] == b" ":
                raw = raw[1:]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "each-byte").encode()
            out.append(raw)
        return out


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)
_models: dict[str, PieceModel] = {}


def model(model_file: str) -> PieceModel:
    """The model, loaded once in each Python worker."""
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids with begin and end, and the text that they decode to.

    One row per input row, repeated rows and null ids too; a null or empty text has two ids. Extra columns are ignored;
    an empty table gives no rows. A very long text is encoded whole, by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in slices(batches, "text", 6 << 20):
            ids, offsets = m.encode(strings(batch, "text"))
            decoded = m.decode(ids, offsets)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """As :func:`encode_documents`, with digests in place of ids and texts, so that neither leaves the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, "text", 6 << 20):
            ids, offsets = m.encode(strings(batch, "text"))
            little = ids.astype("<u4")
            hashed = [sha(little[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(hashed), pa.array([sha(t) for t in m.decode(ids, offsets)])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), tokenizer_files.path("piece_bpe_32k.model"))
