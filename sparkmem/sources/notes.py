"""Markdown notes, one row per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_notes(spark: SparkSession, directory: str) -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", "*.md")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
    )
