"""The memory table as Parquet, split by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import fades_at, instant, null_empty, stored_base
from ..options import DAILY_TO_MONTHLY, MONTHLY_TO_YEARLY, DecayOptions, SettleRule
from ..schema import MEMORY, conform


def read_memories(spark: SparkSession, path: str, vectors: bool = True) -> DataFrame:
    """The whole table; without vectors the embedding column is never read."""
    df = spark.read.schema(MEMORY).parquet(path).select(*MEMORY.names)
    return df if vectors else df.drop("embedding")


def write_memories(
    df: DataFrame, path: str, rules: tuple[SettleRule, ...] = (DAILY_TO_MONTHLY, MONTHLY_TO_YEARLY), decay_opts: DecayOptions = DecayOptions(),
) -> None:
    """Write a new version to a fresh path; empty values become NULL.

    ``due_at`` is added: when a row falls below the threshold at which its tier settles. Rows of a tier lie by the month they
    fall due in, then by user and time, so the statistics of row groups let a reader skip what is not due yet and, in what is left,
    other users.
    """
    rows = null_empty(conform(df))
    due = F.lit(None).cast("timestamp")
    for rule in rules:
        own = F.col("tier") == rule.source_tier
        if rule.adopt_untiered:
            own = own | F.col("tier").isNull()
        due = F.when(own, fades_at(stored_base(), "access_count", "created_at", rule.threshold, decay_opts)).otherwise(due)
    rows = rows.withColumn("due_at", due)
    order = ["tier", F.date_trunc("month", "due_at"), "user_id", "created_at"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("tier").parquet(path)


def read_due(spark: SparkSession, path: str, rule: SettleRule, now) -> DataFrame:
    """The rows ``rule`` may settle at ``now``: the filter on ``due_at`` reaches the scan, so row groups that are not due are not read.

    All rows below the threshold are among them, if the table was written with the decay options that ``settle`` is given.
    """
    rows = spark.read.schema(T.StructType([*MEMORY.fields, T.StructField("due_at", T.TimestampType())])).parquet(path)
    tier = F.col("tier") == rule.source_tier
    if rule.adopt_untiered:
        tier = tier | F.col("tier").isNull()
    return rows.where(tier).where(F.col("due_at") <= instant(now)).select(*MEMORY.names)
