"""A training corpus from raw documents, in five stages. Each stage's output is a Parquet table, the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsloom.llm import decontaminate, language_id, near_dedup, packing, pii
from prsloom.tables import drop, scratch, written

#: Of a kept document's words, the likeliest language has this share at least.
LEAST_SHARE = 0.5


def sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose words have no prevailing language, go."""
    return language_id.accepted(docs, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, likeness 0.8."""
    return near_dedup.without_near_duplicates(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; others lose the words of such windows."""
    return sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return sized(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmarks), ("PII", personal), ("best-fit packing", packed)]

#: SQL can express none of the models: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage wrote on its way, and its input, are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            done = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(done)
        if k:
            drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
