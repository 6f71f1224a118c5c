"""Condensing rounds into memories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import instant, new_id, strip_tool_calls
from ..functions.models import extractive_summarizer, hashing_embedder
from ..functions.responses import parse_replies
from ..operators.conversation import (
    CONVERSATION,
    assemble_conversation,
    round_batches,
    with_batch_id,
    without_consumed,
)
from ..options import SummaryOptions
from ..schema import MEMORY, conform
from ..sources.staging import stage


class Remembered(NamedTuple):
    memories: DataFrame
    leftover: DataFrame  # rounds of batches too short to condense
    quarantined: DataFrame  # batches whose reply was unusable, with their text
    consumed: DataFrame  # (user_id, conv_id, round_id, batch_id) of the rounds that became memories


def summarize_batches(
    rounds: DataFrame,
    now,
    summarizer=None,
    embedder=None,
    opts: SummaryOptions = SummaryOptions(),
    consumed: DataFrame | None = None,
    known: DataFrame | None = None,
) -> Remembered:
    """Rounds → batches → texts → summaries → vectors → memory rows. The summarizer runs once, at the call.

    Over a growing log, give the ``consumed`` rounds of all earlier calls: they are left out. Batches whose
    memory id is in ``known`` (id) are not condensed again. Rounds that were too few or got
    no usable reply stay unconsumed, so the next call meets them again.
    """
    if consumed is not None:
        rounds = without_consumed(rounds, consumed)
    return remember(numbered_batches(rounds, opts), now, summarizer, embedder, opts, known)


def remember(
    batches: DataFrame,
    now,
    summarizer=None,
    embedder=None,
    opts: SummaryOptions = SummaryOptions(),
    known: DataFrame | None = None,
) -> Remembered:
    """``summarize_batches`` from rounds that are cut into batches (with ``batch_id``) already."""
    ready = F.col("batch_size") >= opts.min_rounds
    texts = assemble_conversation(batches.where(ready), opts)
    if known is not None:
        texts = texts.withColumn("id", _memory_id()).join(known.select("id"), "id", "left_anti").drop("id")
    replies = summarized(texts, summarizer or extractive_summarizer(opts.user_label), opts)
    usable = replies.where(F.col("problem").isNull())
    day = F.date_format("first_ts", "yyyy-MM-dd")
    memories = memory_rows(
        usable,
        F.concat(F.lit("session-"), day, F.lit("-"), F.substring(F.sha2("batch_id", 256), 1, 8)),
        "auto_summary",
        now,
        embedder,
    )
    quarantined = replies.where(F.col("problem").isNotNull()).select(
        "batch_id", *CONVERSATION, "batch_no", "text", "raw", "problem"
    )
    rounds = batches.select(*CONVERSATION, "round_id", "batch_id")
    return Remembered(
        memories, batches.where(~ready), quarantined, rounds.join(usable.select("batch_id"), "batch_id", "left_semi")
    )


def _memory_id():
    return new_id("mem-", "batch_id")


def numbered_batches(rounds: DataFrame, opts: SummaryOptions) -> DataFrame:
    clean = rounds.withColumn("assistant_text", strip_tool_calls("assistant_text"))
    return with_batch_id(round_batches(clean, opts.every))


def summarized(texts: DataFrame, summarizer, opts: SummaryOptions = SummaryOptions()) -> DataFrame:
    """The parsed replies to the texts, written once so that no model call is repeated.

    A text without a reply has a problem, not a gap; texts and raw replies are kept only
    where there is one.
    """
    replies = parse_replies(summarizer(texts), "raw", opts.max_topics, opts.max_facts)
    failed = F.col("problem").isNotNull()
    slim = {c: F.when(failed, F.col(c)) for c in ("text", "raw")}
    return stage(replies.withColumns(slim), "replies")


def memory_rows(usable: DataFrame, session_id, source: str, now, embedder=None) -> DataFrame:
    rows = usable.select(
        _memory_id().alias("id"),
        "user_id",
        F.col("summary").alias("content"),
        "topics",
        "key_facts",
        "importance",
        F.col("importance").alias("base_importance"),
        "sentiment",
        F.lit(source).alias("source"),
        F.lit("daily").alias("tier"),
        F.lit(0).alias("access_count"),
        instant(now).alias("last_accessed"),
        instant(now).alias("created_at"),
        session_id.alias("session_id"),
    )
    return conform((embedder or hashing_embedder())(rows, "content", "embedding"), MEMORY)

