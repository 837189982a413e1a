"""Operator 5: quality rules whose cutoffs are chosen with a guarantee on false rejections. DataFrame functions only.

Every rule compares one ratio of a document with a cutoff; a rung is one cutoff for every rule. For each stratum
(language) the rungs are walked from the loosest to the strictest. At each rung the exact binomial bound of Clopper and
Pearson is held against the labelled good documents of the stratum that any of the rules would reject; the walk ends at
the first rung that cannot be certified, and the last certified one is used. A walk in a fixed order needs no correction
along the ladder (fixed-sequence testing); over strata the level is divided (Bonferroni). With confidence 1 - ``delta``
no stratum loses more than ``alpha`` of its good documents to all rules together. The holdout has each text once, as
copies are no independent draws. With the defaults a stratum certifies something from 90 good documents on, if none of
them is rejected; one with fewer certifies nothing and rejects nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, spread

WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A fixed list, so that the table of cutoffs is bounded; any other language shares one stratum.
STRATA = ("en", "de", "fr", "es")
#: Rule -> cutoffs by rung, from the loosest to the strictest; a document is rejected where its ratio is above the cutoff.
LADDERS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06),
    "duplicate_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeat_ratio": (0.48, 0.45, 0.42, 0.39, 0.36, 0.33, 0.3, 0.27, 0.24, 0.2),
    "capital_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25),
}
RUNGS = 10
ALPHA, DELTA = 0.05, 0.05


def _lgamma(x: Column) -> Column:
    """log Gamma for x >= 1: Stirling's series at x + 8, carried back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p) with k <= n p: the largest term times the sum of the falling ratios below it."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    below = F.filter(F.sequence(F.lit(0), k.cast("int")), lambda i: i > 0)
    return top * F.aggregate(below, start, step, lambda acc: acc["total"])


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the base counts and the ratios of every whole text, and ``text_hash``. A null text counts as an empty one.

    Words that stand in a repeated window are counted inside each row, in O(n log n): the windows' 64-bit hashes are
    sorted with their places, places with an equal neighbour are kept, and sorted places p cover min(3, next p - p).
    """
    blank = F.lit(BLANKS)
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, blank) != "")
    d = d.select(
        *keep,
        F.split(F.btrim(text, blank), WORD_GAP).alias("_words"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
        F.xxhash64(text).alias("text_hash"),
    )
    w = F.col("_words")
    d = d.select(
        *keep, "_words", "n_symbols", "n_capitals", "text_hash",
        F.when(F.element_at(w, 1) == "", F.lit(0)).otherwise(F.size(w)).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumn("_windows", F.when(F.size(w) > 3, hashed))
    v = F.col("_windows")
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct(v)) < F.size(v), F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("_sorted")
    doubled = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    d = d.withColumn("_places", F.sort_array(F.transform(doubled, lambda x: x["p"])))
    q = F.col("_places")
    covered = F.aggregate(
        q,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        _div(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _div(F.col("n_dup_lines"), F.col("n_lines")).alias("duplicate_line_ratio"),
        _div(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
        _div(F.col("n_capitals"), F.col("word_chars")).alias("capital_ratio"), "text_hash",
    )


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labels: ``n`` good documents held out, the last certified ``rung`` (null: none), and one
    column per rule, its cutoff there.

    ``measured`` needs doc_id, lang, text_hash and the ratios; ``labels`` doc_id and quality. The holdout is every
    labelled good document that passes the base rules, each text once. At most len(STRATA) + 1 rows come out, whatever
    the input.
    """
    level = delta / (len(STRATA) + 1)
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_label")).where(F.col("_label").isNotNull()).distinct()
    held = measured.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_label"), "left_semi")
    held = held.withColumn("stratum", stratum(F.col("lang"))).dropDuplicates(["stratum", "text_hash"])

    def rejected(i: int) -> Column:
        return reduce(or_, [F.col(r) > ladder[i] for r, ladder in LADDERS.items()])

    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(rejected(i), 1)).alias(f"k_{i}") for i in range(RUNGS)])
    rungs = counts.select("stratum", "n", F.inline(F.array(*[F.struct(F.lit(i).alias("rung"), F.col(f"k_{i}").alias("k")) for i in range(RUNGS)])))
    passed = F.when(F.col("k") <= F.col("n") * alpha, binomial_tail(F.col("k"), F.col("n"), alpha) <= level).otherwise(F.lit(False))
    stopped = F.coalesce(F.min(F.when(~F.col("passed"), F.col("rung"))), F.lit(RUNGS))
    walked = rungs.withColumn("passed", passed).groupBy("stratum", "n").agg((stopped - 1).alias("rung"))
    walked = walked.withColumn("rung", F.when(F.col("rung") >= 0, F.col("rung")))
    at = {r: F.get(F.array(*map(F.lit, ladder)), F.col("rung")) for r, ladder in LADDERS.items()}
    return walked.select("stratum", "n", "rung", *[c.alias(f"max_{r}") for r, c in at.items()])


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``kept`` and ``failed_rules``. ``chosen`` has a proven bound of rows (see :func:`cutoffs`), so it is broadcast."""
    s = F.col("_stratum")
    chosen = chosen.select("stratum", *[f"max_{r}" for r in LADDERS])
    d = measured.withColumn("_stratum", stratum(F.col("lang"))).join(F.broadcast(chosen), s == F.col("stratum"), "left")
    failed = F.array_compact(F.array(
        F.when(F.col("base_failed"), F.lit("base")), *[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in LADDERS]
    ))
    return d.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0).drop("_stratum", "stratum", *[f"max_{r}" for r in LADDERS])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Judges every document; one row per input row.

    Nulls: a null text is empty (so it fails the base rules), a null language belongs to the stratum ``other``, rows
    with a null doc_id are judged but never used as labels. Repeated rows are judged alike. Empty tables give empty
    results. Extra columns are ignored.
    """
    measured = cut(measures(docs, ["doc_id", "lang"]), "quality-measures")
    return judge(measured, cutoffs(measured, labels.select("doc_id", "quality"), alpha, delta))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
