"""From raw documents to packed training sequences: rules, classifier, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.near_dedup import grouped_rows
from strandloom.llm.packing import pack_documents
from strandloom.llm.quality_cnn import score_quality, train_quality
from strandloom.llm.quality_rules import cutoffs, judge, measures
from strandloom.llm.shared import cut, small_enough, spread
from strandloom.llm.substring_dedup import remove_repeats

#: A document goes if the classifier finds it likelier bad than good.
KEEP_SCORE = 0.5


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one struct beside the columns that a stage reads: its other columns cannot clash with a stage's own."""
    return docs.select(F.struct("*").alias("_doc"), "doc_id", "text", "lang")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the certified cutoffs keep, repeated rows alike. A null or empty text goes; a null id or
    language is judged like any other. An empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    measured = cut(measures(_whole(docs), ["_doc", "doc_id", "lang"]), "pipeline-measures")
    return judge(measured, cutoffs(measured, labels)).where("kept").select("_doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores KEEP_SCORE or more, whatever its length, by a network trained on the labelled rows at
    hand; a null text is an empty one. An empty table, or one without labels, is scored by an untrained network."""
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(_whole(docs), net, ["_doc"]).where(F.col("score") >= KEEP_SCORE).select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows that repeat one id and text count as one document.

    Of a group's texts under its least id the one of the least hash stays. Texts without words are groups of their own.
    """
    kept = grouped_rows(docs).where("kept").groupBy("root", F.col("doc_id").alias("_stays"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("n"))
    own = F.when(F.col("root").isNull(), F.col("_hash"))
    stay = kept.groupBy("root", own.alias("own"), "_stays").agg(F.min(F.struct("_hash", "n")).alias("m"))
    stay = cut(stay.select("_stays", "m._hash", "m.n"), "pipeline-kept")
    mine = F.col("doc_id").eqNullSafe(F.col("_stays")) & (F.xxhash64("text") == F.col("_hash"))
    once, repeated = stay.where("n = 1").select("_stays", "_hash"), stay.where("n > 1").select("_stays", "_hash")
    return docs.join(small_enough(once), mine, "left_semi").union(docs.join(small_enough(repeated), mine, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows; a text that lost words has its new length in ``n_chars``."""
    left = remove_repeats(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row's tokens, with its place in a sequence; a null text has the end id alone."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again by the next.

    Rows of the last stage, see :func:`packing`; an empty table gives none.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
