"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmem.llm.common import read_table
from sparkmem.llm.decontamination import without_contaminated
from sparkmem.llm.neardup import without_near_duplicates
from sparkmem.llm.packing import packed
from sparkmem.llm.pii import pseudonymised
from sparkmem.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from sparkmem.sources.staging import stage

#: Bytes of rows that a Python worker is given at a time. The JVM and the worker hold a batch several times over.
BATCH_BYTES = 4 << 20


def _in_small_batches(step):
    """Bounds the batches by bytes: 10,000 texts together, Spark's default, are as large as the texts happen to be."""
    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return step(spark, docs, sf_dir)

    return run


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages score ``THRESHOLD`` or more go."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where(F.col("score") < THRESHOLD).select(*docs.columns)


@_in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return without_near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


@_in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates in the texts; n_chars follows the new text."""
    clean = pseudonymised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


@_in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 1,024 tokens with the sources in their shares."""
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: The stages learn models, sample hashes and tokenize: SQL cannot express them; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
