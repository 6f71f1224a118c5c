"""The archive of settled memories: JSON lines by tier and period, never deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MEMORY

_METADATA = [f for f in MEMORY.fields if f.name not in ("id", "content", "embedding")]

ARCHIVE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StructType(_METADATA)),
        T.StructField("merged_into", T.StringType()),
        T.StructField("archived_at", T.TimestampType()),
        T.StructField("tier", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)


def archive_records(archived: DataFrame) -> DataFrame:
    """Settled memories as archive records: id, content, metadata, where they went and when."""
    return archived.select(
        "id",
        "content",
        F.struct(*[F.col(f.name) for f in _METADATA]).alias("metadata"),
        "merged_into",
        "archived_at",
        "tier",
        "period",
    )


def write_archive(archived: DataFrame, path: str, run: str | None = None) -> None:
    """Add the rows under ``run``, by default a new name. Writing a run again replaces its own files and no others."""
    rows = archive_records(archived).withColumn("run", F.lit(run or uuid.uuid4().hex))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("tier", "period", "run").json(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).json(path).select(*ARCHIVE.names)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Which file holds which id."""
    return spark.read.schema(ARCHIVE).json(path).select("id", F.col("_metadata.file_path").alias("path"))


def lookup_archive(archive: DataFrame, ids: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The archived originals of ``ids``, one row each even if a repeated write left several; with the index, also a file of each."""
    found = archive.join(ids.select("id").distinct(), "id").dropDuplicates(["id"])
    return found if index is None else found.join(index.groupBy("id").agg(F.min("path").alias("path")), "id")


def write_archive_index(spark: SparkSession, path: str, index: str, run: str) -> None:
    """Add one run of the archive at ``path`` to the kept index: which file holds which id.

    Only that run's files are read. Rows lie by id with Bloom filters, so a reader of a few ids skips most row groups.
    Writing a run again replaces its own rows and no others.
    """
    files = spark.read.schema(ARCHIVE).option("basePath", path).json(f"{path}/tier=*/period=*/run={run}")
    rows = files.select("id", F.col("_metadata.file_path").alias("path")).withColumn("run", F.lit(run))
    (rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#id", "true").partitionBy("run").parquet(index))


def find_archived(spark: SparkSession, path: str, index: str, ids: DataFrame, few: int = 1000, most_files: int = 10_000) -> DataFrame:
    """The archived originals of ``ids``, one row each, read from the files the index names and no others.

    Up to ``few`` ids go to the scan of the index as a filter, where Bloom filters meet them; more are joined. Where more than
    ``most_files`` files hold them the whole archive is read instead; both ways give the same rows.
    """
    wanted = ids.select("id").where(F.col("id").isNotNull()).distinct()
    entries = spark.read.schema("id string, path string, run string").parquet(index)
    head = [r.id for r in wanted.limit(few + 1).collect()]
    found = entries.where(F.col("id").isin(head)) if len(head) <= few else entries.join(wanted, "id", "left_semi")
    files = [r.path for r in found.select("path").distinct().limit(most_files + 1).collect()]
    if not files:
        return spark.createDataFrame([], ARCHIVE)
    reader = spark.read.schema(ARCHIVE).option("basePath", path)
    archive = (reader.json(files) if len(files) <= most_files else reader.json(path)).select(*ARCHIVE.names)
    return lookup_archive(archive, wanted)
