"""Recalling memories for many prompts at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import effective_importance, instant, recall_line, recall_score, truncate_marked
from ..functions.models import hashing_embedder
from ..operators.ordering import top_rows
from ..operators.search import knn
from ..options import DecayOptions, RecallOptions
from ..sources.staging import stage

_CARRY = ("importance", "base_importance", "access_count", "created_at", "tier")
_TEXTS = ("content", "topics")


class Recall(NamedTuple):
    hits: DataFrame
    updates: DataFrame


def recall(
    queries: DataFrame,
    memories: DataFrame,
    now,
    opts: RecallOptions = RecallOptions(),
    decay_opts: DecayOptions = DecayOptions(),
    embedder=None,
) -> Recall:
    """Best memories per prompt by similarity and faded importance, and the updates they cause.

    ``queries``: query_id, user_id and q_embedding, or the text ``prompt`` to embed; an
    empty prompt recalls nothing.

    Candidates are the nearest by cosine, before scoring. All prompts see one state of
    the table; a memory hit n times gains n accesses.
    """
    if "q_embedding" not in queries.columns:
        # Written once: the search reads the prompts several times, and each reading would call the model again.
        queries = stage((embedder or hashing_embedder())(queries.where(F.col("prompt") != ""), "prompt", "q_embedding"), "prompts")
    marked = memories.withColumn("_said", _mark())
    near = knn(queries, marked, opts.candidates, min_cosine=opts.min_cosine, carry=(*_CARRY, "_said"))
    best = rerank(score(near, now, opts, decay_opts), opts)
    return Recall(_with_texts(best, memories), recall_updates(best, now))


def _mark():
    """Tells apart rows of one id that say different things."""
    return F.xxhash64(*_TEXTS)


def _with_texts(best: DataFrame, memories: DataFrame) -> DataFrame:
    """The texts of the hits that are left; candidates and the ranking do without. One row a hit, however often an id is there."""
    key = ["user_id", "id", "_said"]
    texts = memories.withColumn("_said", _mark()).groupBy(*key).agg(F.any_value(F.struct(*_TEXTS)).alias("_texts"))
    found = best.join(texts, key)
    order = [c for c in best.columns if c != "_said"]
    at = order.index("distance") + 1
    return found.select(*order[:at], *[f"_texts.{c}" for c in _TEXTS], *order[at:])


def score(candidates: DataFrame, now, opts: RecallOptions = RecallOptions(), decay_opts=DecayOptions()) -> DataFrame:
    base = F.coalesce("base_importance", F.lit(0.5))
    eff = effective_importance(base, F.col("access_count"), F.col("created_at"), now, decay_opts)
    return candidates.withColumn("effective", eff).withColumn(
        "score", recall_score("cosine", "effective", opts.weight_similarity, opts.weight_importance)
    )


def passing(scored: DataFrame, opts: RecallOptions = RecallOptions()) -> DataFrame:
    return scored.where((F.col("score") >= opts.min_score) & (F.col("cosine") >= opts.min_cosine))


def rerank(scored: DataFrame, opts: RecallOptions = RecallOptions()) -> DataFrame:
    """Per prompt, the best passing candidates by score, then cosine, then id."""
    return top_rows(
        passing(scored, opts).drop("rank"),
        ["query_id"],
        [F.desc("score"), F.desc("cosine"), "id"],
        opts.top_k,
    )


def recall_updates(hits: DataFrame, now) -> DataFrame:
    """One metadata update per hit memory; importance is what the hit saw."""
    return hits.groupBy("id").agg(
        (F.coalesce(F.any_value("access_count"), F.lit(0)) + F.count("*")).cast("int").alias("access_count"),
        instant(now).alias("last_accessed"),
        F.any_value("effective").alias("importance"),
    )


def recall_increments(hits: DataFrame, now) -> DataFrame:
    """What ``hits`` add to each hit memory. Unlike ``recall_updates`` these add up over any number of batches."""
    return hits.groupBy("id").agg(
        F.count("*").alias("hits"), instant(now).alias("last_hit"), F.any_value("effective").alias("importance")
    )


def recall_context(hits: DataFrame, opts: RecallOptions = RecallOptions()) -> DataFrame:
    """Per prompt with hits, the text to show, cut to the limit."""
    line = recall_line(
        "created_at", "content", "topics", "cosine", "effective", "score",
        opts.weight_similarity, opts.weight_importance,
    )
    line = F.substring(line, 1, opts.max_chars + 1)  # no more of it can be shown, and so much tells that the text is too long
    head, tail = opts.template.split("{memories}")
    ordered = F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).getField("line")
    block = F.concat(F.lit(head), F.array_join(ordered, "\n"), F.lit(tail))
    return hits.groupBy("query_id").agg(truncate_marked(block, opts.max_chars, opts.cut_marker).alias("context"))


# How much a tier counts.
TIER_WEIGHT = {"daily": 1.0, "monthly": 0.85, "yearly": 0.5}


def tier_weighted_rank(hits: DataFrame, k: int) -> DataFrame:
    """Rank by effective importance × tier weight ÷ distance."""
    weight = F.coalesce(
        *[F.when(F.col("tier") == t, F.lit(w)) for t, w in TIER_WEIGHT.items()], F.lit(TIER_WEIGHT["daily"])
    )
    scored = hits.drop("rank").withColumn(
        "tier_score", F.col("effective") * weight / F.greatest("distance", F.lit(1e-6))
    )
    return top_rows(scored, ["query_id"], [F.desc("tier_score"), "id"], k)
