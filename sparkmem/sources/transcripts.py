"""Transcript files, line by line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, line_no, value). ``line_no`` orders the lines of a file: start of the
    split, then place in it, so long files are still read in parallel."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("transcript"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("line_no"),
        "value",
    )
