"""Small pieces the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT = 2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replacing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; where the input already has one of that name, the new one takes its place."""
    return df.withColumns(columns)


def whole(text: str = "text") -> Column:
    """A text, with NULL read as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label of which is ever learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """All (doc_id, label) that may be learned from, one row an id.

    Rows of the held-out remainder are never among them. A doc_id labelled twice counts with its larger label.
    """
    return (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` of the ``labelled`` texts of each class, by order of a hash: (doc_id, text, label).

    The sampled ids are few by construction (2 × limit), so they are broadcast and the texts are read in one narrow scan.
    """
    known = labelled(labels, label)
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(limit)
        picked = part if picked is None else picked.unionByName(part)
    slim = docs.select("doc_id", whole().alias("text"))
    return slim.join(F.broadcast(picked), "doc_id")
