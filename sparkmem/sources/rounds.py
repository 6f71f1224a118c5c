"""Logged rounds: JSON lines in, JSON lines out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import new_id, parse_created, strip_tool_calls
from ..operators.ordering import number_rows
from ..schema import ROUND_LINE


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed lines; blank and broken ones are skipped."""
    reader = spark.read.schema(ROUND_LINE).option("mode", "DROPMALFORMED")
    return rounds_from_lines(reader.json(path))


def stream_rounds(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ROUND_LINE).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return rounds_from_lines(reader.json(path))


def rounds_from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.coalesce("user_id", F.lit(0).cast("long")).alias("user_id"),
        F.coalesce("conv_id", F.lit("")).alias("conv_id"),
        F.col("id").alias("round_id"),
        F.coalesce("user", F.lit("")).alias("user_text"),
        F.coalesce("assistant", F.lit("")).alias("assistant_text"),
        parse_created("timestamp", F.timestamp_seconds(F.lit(0))).alias("ts"),
    )


def append_rounds(rounds: DataFrame, path: str, existing: DataFrame | None = None, run: str | None = None) -> None:
    """Append rounds with their number in the conversation, tool-call blocks removed.

    The rows lie under ``run``, by default a new name: writing a run again replaces its own files and no others.
    ``existing`` is what the log holds without this run; numbering goes on after it. A round without an id gets one
    that follows from run, conversation and number, so a repeated write gives the same.
    """
    run = run or uuid.uuid4().hex
    numbered = number_rows(rounds, ["user_id", "conv_id"], ["ts", "round_id"])
    number = F.col("position")
    if existing is not None:
        held = existing.groupBy("user_id", "conv_id").agg(F.count("*").alias("_held"))
        same = numbered["user_id"].eqNullSafe(held["user_id"]) & numbered["conv_id"].eqNullSafe(held["conv_id"])
        numbered = numbered.join(held, same, "left").drop(held["user_id"], held["conv_id"])
        number = number + F.coalesce("_held", F.lit(0))
    lines = numbered.withColumn("round", number).select(
        F.coalesce("round_id", new_id("round-", F.lit(run), "user_id", "conv_id", "round")).alias("id"),
        "user_id",
        F.col("conv_id").cast("string").alias("conv_id"),
        "round",
        F.col("user_text").alias("user"),
        strip_tool_calls("assistant_text").alias("assistant"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit(run).alias("run"),
    )
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)
