"""Operator 9: removal of passages that an earlier document has, found by recompression.

Each round gives names to runs of equal symbols and to pairs of a left and a right symbol, the sides being drawn from
the symbols' names, so that equal substrings get equal symbols in their interior, wherever they stand. With every symbol
goes its context, the words that decided it; a window that holds a symbol's whole context has that symbol wherever it
occurs.

The lower rounds run inside the scan: a name is a hash of what it stands for and of the round, on which all tasks agree
without an exchange. They leave symbols of some six words. The upper rounds are Spark's: a table of all names of the
round, over all documents, says which are shared and between which ids; it is joined back, windows that decide a symbol
of no other document are out, and what is left makes the next round's runs and pairs. Shared high-level symbols reveal
where repeats can be.

Windows that are left are named one by one, by 128 bits from two independent hashes of their words, and grouped by that
name to verify the repeat: no symbol's name decides a removal. Copies of a whole word sequence are settled as one.
Windows that decide no symbol (within very long runs) are all named, so that nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, join_hot, small_enough, spare, spread
from .text import GOLDEN, lengths_to_rows, mix, ragged, slices, split_words, strings, word_hashes

WINDOW = 50
#: Rounds of naming inside the scan, all rounds, and those of them that name runs as well as pairs.
ROUNDS, ALL_ROUNDS, RUN_ROUNDS = 6, 8, (0, 3, 6)


def recompress(names: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round for documents of word names: name, document, and the context's first and past-last word.

    A document's ends decide symbols too, but no window can hold them: there the context reaches outside.
    """
    lo = np.arange(len(names))
    return name_rounds(names, lengths_to_rows(np.diff(offsets)), lo, lo + 1, offsets, range(rounds))


def name_rounds(names: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, offsets: np.ndarray, rounds: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """These rounds over the symbols at hand. ``offsets`` are those of the documents' words."""
    first, last = offsets[:-1], offsets[1:]
    for r in rounds:
        if not len(names):
            break
        seed = np.uint64((r + 1) * int(GOLDEN) % 2**64)
        same_doc = doc[1:] == doc[:-1]
        if r in RUN_ROUNDS:
            edge = np.concatenate([[True], ~same_doc | (names[1:] != names[:-1])])
            starts = np.flatnonzero(edge)
            size = np.diff(np.append(starts, len(names)))
            ends = starts + size
            # What a run is, its two neighbours decide.
            before = np.where(starts > 0, starts - 1, 0)
            after = np.minimum(ends, len(names) - 1)
            left = np.where((starts > 0) & (doc[before] == doc[starts]), lo[before], first[doc[starts]] - 1)
            right = np.where((ends < len(names)) & (doc[after] == doc[starts]), hi[after], last[doc[starts]] + 1)
            lo, hi = np.minimum(lo[starts], left), np.maximum(hi[ends - 1], right)
            one = names[starts]
            names, doc = np.where(size > 1, mix(mix(one ^ seed) + size.astype(np.uint64)), one), doc[starts]
            same_doc = doc[1:] == doc[:-1]
        side = (mix(names + seed) >> np.uint64(63)).astype(bool)  # True: right
        joins = np.concatenate([same_doc & ~side[:-1] & side[1:], [False]])  # with the next symbol
        tail = np.concatenate([[False], joins[:-1]])
        # A symbol that stays alone was decided by the neighbour on its open side.
        next_lo_hi = np.concatenate([np.where(same_doc, hi[1:], last[doc[:-1]] + 1), last[doc[-1:]] + 1])
        prev_lo = np.concatenate([first[doc[:1]] - 1, np.where(same_doc, lo[:-1], first[doc[1:]] - 1)])
        alone = ~joins & ~tail
        new_hi = np.where(joins, np.maximum(hi, np.append(hi[1:], 0)), np.where(alone & ~side, np.maximum(hi, next_lo_hi), hi))
        new_lo = np.where(joins, np.minimum(lo, np.append(lo[1:], 0)), np.where(alone & side, np.minimum(lo, prev_lo), lo))
        merged = mix(mix(names ^ seed) + np.append(names[1:], np.uint64(0)) * np.uint64(3))
        keep = ~tail
        names, lo, hi, doc = np.where(joins, merged, names)[keep], new_lo[keep], new_hi[keep], doc[keep]
    return names, doc, lo, hi


def symbol_ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window (by its first word, and the document): the range of symbols whose contexts it holds.

    Contexts are made monotonic first, by widening them, which only takes symbols out of windows.
    """
    n = np.diff(offsets)
    count = np.maximum(0, n - window + 1)
    at = ragged(offsets[:-1], count)
    low = np.minimum.accumulate(lo[::-1])[::-1] if len(lo) else lo
    high = np.maximum.accumulate(hi) if len(hi) else hi
    a = np.searchsorted(low, at, "left")
    b = np.searchsorted(high, at + window, "right")
    return at, a, np.maximum(a, b)


def window_names(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit name for the ``window`` words (by their hashes) from each place on, meaningless where they overrun."""
    power, size, total, done = words, 1, None, 0
    while size <= window:
        if window & size:
            part = np.concatenate([power[done:], np.zeros(min(done, len(power)), np.uint64)])[: len(words)]
            total = mix(part + np.uint64(size)) if total is None else mix(total * np.uint64(5) + part)
            done += size
        shifted = np.concatenate([power[size:], np.zeros(min(size, len(power)), np.uint64)])[: len(words)]
        power, size = mix(power * np.uint64(3) + shifted), size * 2
    return mix(total).view(np.int64)


def _words(texts: pa.Array, *seeds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets, and for each seed an own 64-bit hash of every word."""
    offsets, codes, vocabulary = split_words(texts)
    return offsets, [word_hashes(vocabulary, s)[codes] if len(vocabulary) else np.zeros(0, np.uint64) for s in seeds]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: together they tell rows apart where ids are repeated."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))


def _ranges(mask: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """For each stretch of ``mask`` (one of ``offsets``) where it is set: starts and ends, in turn, counted from the stretch's start."""
    rows = lengths_to_rows(np.diff(offsets))
    new = np.ones(len(mask), bool)
    new[1:] = rows[1:] != rows[:-1]
    before, after = np.concatenate([[False], mask[:-1]]) & ~new, np.concatenate([mask[1:], [False]]) & ~np.append(new[1:], True)
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    flat = np.stack([starts - offsets[rows[starts]], ends - offsets[rows[starts]]], axis=1).astype(np.int32).ravel()
    return _lists(flat, 2 * np.bincount(rows[starts], minlength=len(offsets) - 1))


def _mask(ranges: pa.ListArray, offsets: np.ndarray) -> np.ndarray:
    """The mask that :func:`_ranges` made its lists from."""
    flat = np.asarray(ranges.flatten(), np.int64).reshape(-1, 2)
    rows = lengths_to_rows(np.asarray(ranges.value_lengths().fill_null(0), np.int64) // 2)
    depth = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(depth, flat[:, 0] + offsets[rows], 1)
    np.add.at(depth, flat[:, 1] + offsets[rows], -1)
    return np.cumsum(depth[:-1]) > 0


STATE = "doc_id long, text_hash long, n_words long, names array<long>, lo array<int>, width array<int>, later array<int>, earlier array<int>"


def _state(ids: list[pa.Array], n: np.ndarray, doc: np.ndarray, names: np.ndarray, lo: np.ndarray, hi: np.ndarray, offsets: np.ndarray, later: pa.ListArray, earlier: pa.ListArray, more: dict | None = None) -> pa.RecordBatch:
    """Rows of documents between two rounds: symbols (name 0: in no window that counts), their contexts, and the windows
    that can have a source (``later``) or be one (``earlier``)."""
    listed = np.bincount(doc, minlength=len(n))
    columns = {"doc_id": ids[0], "text_hash": ids[1], "n_words": pa.array(n), "names": _lists(names.view(np.int64), listed), "lo": _lists((lo - offsets[doc]).astype(np.int32), listed), "width": _lists((hi - lo).astype(np.int32), listed), "later": later, "earlier": earlier}
    columns |= more or {}
    return pa.record_batch(list(columns.values()), names=list(columns))


def _symbols(docs: DataFrame, window: int) -> DataFrame:
    """STATE after the rounds inside the scan, and ``sequence``, which names the whole word sequence, for documents of at least ``window`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, (words,) = _words(strings(batch, "text"), 9)
            long = np.diff(offsets) >= window
            kept = np.repeat(long, np.diff(offsets))
            batch, words = batch.filter(pa.array(long)), words[kept]
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[long])])
            names, doc, lo, hi = recompress(words, offsets)
            inside = (lo >= offsets[doc]) & (hi <= offsets[doc + 1]) & (hi - lo <= window)  # others are in no window
            n = np.diff(offsets)
            whole = [xxhash.xxh3_128_digest(words[x:y].tobytes()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            every = np.concatenate([[0], np.cumsum(n - window + 1)])
            windows = _ranges(np.ones(int(every[-1]), bool), every)
            yield _state([batch.column(0), batch.column(2)], n, doc, np.where(inside, names | np.uint64(1), np.uint64(0)), lo, hi, offsets, windows, windows, {"sequence": pa.array(whole, pa.binary())})

    return docs.mapInArrow(run, STATE + ", sequence binary")


def _next_round(state: DataFrame, marks: DataFrame, r: int, window: int) -> DataFrame:
    """STATE after round ``r``, for documents with windows left. ``marks`` lists each document's names that lower
    (``has_lower``) or higher ids (``has_higher``) have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2), np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            listed = np.asarray(batch.column(3).value_lengths(), np.int64)
            names, doc = np.asarray(batch.column(3).flatten(), np.int64).view(np.uint64), lengths_to_rows(listed)
            lo = np.asarray(batch.column(4).flatten(), np.int64) + offsets[doc]
            hi = lo + np.asarray(batch.column(5).flatten(), np.int64)
            at, a, b = symbol_ranges(doc, lo, hi, offsets, window)
            every = np.concatenate([[0], np.cumsum(n - window + 1)])
            here = mix(names + doc.astype(np.uint64) * GOLDEN)
            left, shared = [], np.zeros(len(names), bool)
            for windows, marked in ((6, 8), (7, 9)):
                lists = batch.column(marked)
                of = lengths_to_rows(np.asarray(lists.value_lengths().fill_null(0), np.int64))
                fine = np.isin(here, mix(np.asarray(lists.flatten(), np.int64).view(np.uint64) + of.astype(np.uint64) * GOLDEN))
                missing = np.concatenate([[0], np.cumsum(~fine & (names != 0))])
                left.append(_mask(batch.column(windows), every) & (missing[b] == missing[a]))  # all symbols that the window decides occur there
                shared |= fine
            some = np.concatenate([[0], np.cumsum(left[0] | left[1])])
            keep = some[every[1:]] > some[every[:-1]]
            names, doc, lo, hi = name_rounds(names, doc, lo, hi, offsets, range(r, r + 1))
            # Only symbols that a window still left decides count from here on: windows from hi - window to lo.
            first = np.clip(hi - window - offsets[doc] + every[doc], every[doc], every[doc + 1])
            last = np.clip(lo - offsets[doc] + 1 + every[doc], every[doc], every[doc + 1])
            inside = (lo >= offsets[doc]) & (hi <= offsets[doc + 1]) & (hi - lo <= window) & (some[np.maximum(last, first)] > some[first])
            ok, rows = keep[doc], pa.array(keep)
            kept_n = n[keep]
            place = np.cumsum(keep) - 1
            shift = np.concatenate([[0], np.cumsum(kept_n)])
            moved = place[doc[ok]]
            by = (shift[moved] - offsets[doc[ok]]) if len(moved) else np.zeros(0, np.int64)
            yield _state([batch.column(0).filter(rows), batch.column(1).filter(rows)], kept_n, moved, np.where(inside, names | np.uint64(1), np.uint64(0))[ok], lo[ok] + by, hi[ok] + by, shift, *(_ranges(x, every).filter(rows) for x in left))

    columns = [f.strip().split(" ")[0] for f in STATE.split(",")]
    joined = state.select(*columns).join(marks, ["doc_id", "text_hash"], "left")
    return joined.mapInArrow(run, STATE)


def _marks(state: DataFrame) -> DataFrame:
    """(doc_id, text_hash, has_lower, has_higher): by the table of this round's names over all documents."""
    listed = state.select("doc_id", "text_hash", F.explode(F.array_distinct("names")).alias("name")).where("name <> 0")
    names = listed.groupBy("name").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count("*").alias("n"))
    names = cut(names.where("lowest < highest"), "names")
    seen = join_hot(listed, names, ["name"], "n")
    lower, higher = F.when(F.col("lowest") < F.col("doc_id"), F.col("name")), F.when(F.col("highest") > F.col("doc_id"), F.col("name"))
    return seen.groupBy("doc_id", "text_hash").agg(F.collect_list(lower).alias("has_lower"), F.collect_list(higher).alias("has_higher"))  # no longer than the document


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, starts): the first words of the windows to remove; null ``starts`` stands for all of them."""
    docs = _keyed(docs).where(F.col("doc_id").isNotNull())
    parsed = cut(_symbols(docs, window).dropDuplicates(["doc_id", "text_hash"]), "symbols")

    firsts = cut(parsed.groupBy("sequence").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = join_hot(parsed.select("doc_id", "text_hash", "sequence"), firsts, ["sequence"], "n").where(F.col("doc_id") > F.col("first"))
    copies = cut(copies.select("doc_id", "text_hash"), "copies")

    state = parsed.join(small_enough(copies), ["doc_id", "text_hash"], "left_anti")
    for r in range(ROUNDS, ALL_ROUNDS):
        state = cut(_next_round(state, _marks(state), r, window), "round")

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, seeded = _words(strings(batch, "text"), 9, 10)
            every = np.concatenate([[0], np.cumsum(np.diff(offsets) - window + 1)])
            later, earlier = (_mask(batch.column(k), every) for k in (3, 4))
            row = lengths_to_rows(np.diff(every))
            take = np.flatnonzero(later | earlier)
            row, start = row[take], take - every[row[take]]
            h, g = (window_names(words, window)[offsets[row] + start] for words in seeded)
            # A document's windows of one name are one row.
            order = np.lexsort((start, g, h, row))
            h, g, row, start, take = h[order], g[order], row[order], start[order], take[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            begins = np.flatnonzero(new)
            either = [np.maximum.reduceat(x[take], begins) if len(begins) else np.zeros(0, bool) for x in (later, earlier)]
            starts = _lists(start.astype(np.int32), np.diff(np.append(begins, len(h))))
            rows = pa.array(row[begins])
            yield pa.record_batch([pa.array(h[begins]), pa.array(g[begins]), batch.column(0).take(rows), batch.column(2).take(rows), starts, *map(pa.array, either)], names=["h", "g", "doc_id", "text_hash", "starts", "later", "earlier"])

    wanted = state.select("doc_id", "text_hash", "later", "earlier")
    texts = rows_of(docs, wanted, "left_semi").dropDuplicates(["doc_id", "text_hash"]).join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "later", "earlier")
    windows = cut(texts.mapInArrow(name_windows, "h long, g long, doc_id long, text_hash long, starts array<int>, later boolean, earlier boolean"), "windows")
    least = windows.groupBy("h", "g").agg(F.min(F.when(F.col("earlier"), F.col("doc_id"))).alias("source"), F.max(F.when(F.col("later"), F.col("doc_id"))).alias("last"), F.count_if("later").alias("n"))
    least = cut(least.where("source < last").drop("last"), "sources")
    repeats = join_hot(windows.where("later").select("h", "g", "doc_id", "text_hash", "starts"), least, ["h", "g"], "n").where(F.col("source") < F.col("doc_id"))
    starts = repeats.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # no longer than the document
    return cut(starts.unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>"))), "repeats")


def rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with a table of keys: the texts are shuffled only where the keys are many."""
    keys = small_enough(keys.select("doc_id", "text_hash"))
    return docs.join(keys, ["doc_id", "text_hash"], how)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and n_words, n_removed, kept_sha256 (with underscores after a name that is taken).

    Each word covered by a window of ``window`` words whose sequence also starts in a document with a smaller doc_id is
    removed; windows are judged on the input. A text that loses words becomes its kept words joined by one space;
    others stay as they are. ``kept_sha256`` is of the kept words joined by one space in either case. With ``texts``
    off only doc_id and the three are returned.

    A null text is an empty one and stays null. Rows with a null doc_id lose nothing and are nobody's source; rows that
    share a doc_id are not each other's source. One row per input row; an empty table gives none.
    """
    repeats = repeated_windows(docs, window)
    names = docs.columns if texts else ["doc_id"]
    kept_text, key, hidden, all_out, id_, th = (spare(docs, c) for c in ("_kept", "_hash", "_starts", "_copy", "_id", "_th"))
    added = [spare(docs.select(*names), c) for c in ("n_words", "n_removed", "kept_sha256")]
    read = docs.select(*names, F.coalesce("text", F.lit("")).alias(kept_text), F.xxhash64("text").alias(key))
    found = repeats.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(th), F.col("starts").alias(hidden), F.col("starts").isNull().alias(all_out))
    mine = (F.col("doc_id") == F.col(id_)) & (F.col(key) == F.col(th))
    ids = small_enough(found.select(id_, th))
    touched = read.join(ids, mine, "left_semi").join(found, mine).drop(id_, th, key)
    others = read.join(ids, mine, "left_anti").drop(key).withColumns({hidden: F.lit(None).cast("array<int>"), all_out: F.lit(False)})
    width = len(names)
    text_at = names.index("text") if "text" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, kept_text):
            texts_in = strings(batch, kept_text)
            offsets, codes, vocabulary = split_words(texts_in)
            n = np.diff(offsets)
            starts, copy = batch.column(width + 1), np.asarray(batch.column(width + 2), bool)
            per_doc = np.asarray(starts.value_lengths().fill_null(0), np.int64)
            begins = np.repeat(offsets[:-1], per_doc) + np.asarray(starts.flatten(), np.int64)
            depth = np.zeros(len(codes) + 1, np.int64)
            np.add.at(depth, begins, 1)
            np.add.at(depth, begins + window, -1)
            gone = (np.cumsum(depth[:-1]) > 0) | np.repeat(copy, n)
            removed = np.bincount(lengths_to_rows(n), weights=gone, minlength=len(n)).astype(np.int64)
            words = vocabulary.cast(pa.string()).take(pa.array(codes[~gone]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - removed)]), pa.int32()), words)
            joined = pc.binary_join(lists, " ")
            sha = [hashlib.sha256(t).hexdigest() for t in joined.cast(pa.large_binary()).to_pylist()]
            columns = list(batch.columns[:width])
            if text_at is not None:
                columns[text_at] = pc.if_else(pa.array(removed > 0), joined, columns[text_at])
            yield pa.record_batch([*columns, pa.array(n), pa.array(removed), pa.array(sha)], names=[*names, *added])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema.fields[:width])
    return touched.unionByName(others).mapInArrow(run, schema + "`{}` long, `{}` long, `{}` string".format(*added))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), texts=False)
