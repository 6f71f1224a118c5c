"""Importing notes as memories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import instant, new_id
from ..functions.models import extractive_summarizer
from ..operators.corpus import chunk_corpus
from ..operators.filters import exclude_notes, excluded, long_enough
from ..options import SummaryOptions
from .remember import memory_rows, summarized


class Ingested(NamedTuple):
    memories: DataFrame
    files: DataFrame  # per file: excluded or not, chunks imported
    totals: DataFrame  # found, excluded, imported memories
    quarantined: DataFrame


def note_chunks(notes: DataFrame, file_names=(), patterns=(), max_chars: int = 2000, min_chars: int = 50) -> DataFrame:
    """Chunks of the notes that may be imported, with a batch_id each."""
    chunks = chunk_corpus(exclude_notes(notes, file_names, patterns), max_chars, ("user_id", "file_name"))
    return (
        long_enough(chunks, "chunk", min_chars)
        .withColumnRenamed("chunk", "text")
        .withColumn("batch_id", new_id("note-", "user_id", "file_name", "pos"))
    )


def ingest_notes(
    notes: DataFrame,
    now,
    summarizer=None,
    embedder=None,
    file_names=(),
    patterns=(),
    max_chars: int = 2000,
    min_chars: int = 50,
    opts: SummaryOptions = SummaryOptions(),
) -> Ingested:
    """Notes (user_id, file_name, content) → chunks → summaries → memory rows, with counts.

    The summarizer runs once, at the call."""
    if "user_id" not in notes.columns:
        notes = notes.withColumn("user_id", F.lit(0).cast("long"))
    chunks = note_chunks(notes, file_names, patterns, max_chars, min_chars)
    replies = summarized(chunks, summarizer or extractive_summarizer(opts.user_label), opts)
    usable = replies.where(F.col("problem").isNull())
    session = F.concat(
        F.lit("manual-"),
        F.date_format(instant(now), "yyyy-MM-dd"),
        F.lit("-"),
        F.substring(F.sha2("batch_id", 256), 1, 8),
    )
    imported = usable.groupBy("user_id", "file_name").agg(F.count("*").alias("imported"))
    files = notes.select("user_id", "file_name", excluded(file_names, patterns).alias("excluded")).join(imported, ["user_id", "file_name"], "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
    totals = files.agg(
        F.count("*").alias("found"), F.count_if("excluded").alias("excluded"), F.sum("imported").alias("imported")
    )
    return Ingested(
        memory_rows(usable, session, "manual", now, embedder),
        files,
        totals,
        replies.where(F.col("problem").isNotNull()).select("batch_id", "user_id", "file_name", "pos", "text", "raw", "problem"),
    )


def embedding_text(memories: DataFrame, max_chars: int = 150, max_facts: int = 5) -> DataFrame:
    """Add the short text to embed: topics, then facts; the content where both are missing."""
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("topics", none), F.slice(F.coalesce("key_facts", none), 1, max_facts))
    joined = F.array_join(words, " ")
    return memories.withColumn(
        "embedding_text", F.when(joined != "", F.substring(joined, 1, max_chars)).otherwise(F.col("content"))
    )


def reembed(memories: DataFrame, embedder) -> DataFrame:
    """Replace every vector by that of the short text."""
    return embedder(embedding_text(memories).drop("embedding"), "embedding_text", "embedding")
