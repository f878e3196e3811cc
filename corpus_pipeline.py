"""From raw documents to a training mix: quality rules, one document per group of near copies, no benchmark passages, no secrets, mixed sources.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; what it decides takes effect. All but
the last return the columns of ``documents`` (extra columns and their names pass through); the last returns one row per document with the
words that the mix takes of it. Null texts are empty and fall to the base rule of the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxloom.llm import credentials, decontaminate, jaccard, mixture, quality
from taxloom.llm.names import unused
from taxloom.llm.sizes import if_small
from taxloom.session import prepare, settle

#: The rows depend on random orders and on thresholds chosen from labels, which SQL does not express; tests compare with plain Python.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``gone`` (``doc_id, text_hash, lang``). Verdicts are stored as narrow rows and meet the documents
    here: a filter on computed columns would make Spark compute them again inside the condition. The texts are shuffled only if the
    table of what goes is too large to send to every task."""
    key, own, lang = unused(docs.columns, "id", "text", "lang")
    keys = settle(gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.col("lang").alias(lang)).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(own)) & F.col("lang").eqNullSafe(F.col(lang))
    return docs.join(if_small(keys), same, "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    """What the judging stages read; extra columns of the documents stay out, so that no computed column can meet one of the same name."""
    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or a certified cutoff."""
    prepare(spark)
    measured = settle(quality.measure(_keyed(docs)).select("doc_id", "lang", "text_hash", "base_failed", *quality.RULES), "quality")
    cutoffs = settle(quality.certify(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    return _without(docs, quality.judge(measured, cutoffs).where("not kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents."""
    prepare(spark)
    return jaccard.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    prepare(spark)
    marked = decontaminate.mark_hits(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, settle(marked.select("doc_id", "text_hash", "lang", "contaminated"), "marked").where("contaminated"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside the texts."""
    prepare(spark)
    return credentials.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words taken of every document."""
    prepare(spark)
    return mixture.taken_words(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secret_spans", secret_spans),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
