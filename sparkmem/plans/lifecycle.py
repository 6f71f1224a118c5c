"""Ageing and rolling up the memory table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import effective_importance, instant, new_id, period_key, stored_base
from ..functions.models import hashing_embedder
from ..operators.merging import GROUP, extractive_reducer, leading_text
from ..operators.ordering import number_rows
from ..operators.tables import find_merge_target
from ..options import DAILY_TO_MONTHLY, MONTHLY_TO_YEARLY, DecayOptions, SettleRule, SummaryOptions
from ..schema import MEMORY, conform
from ..sources.staging import stage
from .remember import Remembered, summarize_batches


def aged(now, opts: DecayOptions = DecayOptions()):
    return effective_importance(stored_base(), F.col("access_count"), F.col("created_at"), now, opts)


def decay(memories: DataFrame, now, opts: DecayOptions = DecayOptions()) -> DataFrame:
    """Recompute every row's importance; access counts stay."""
    return memories.withColumn("importance", aged(now, opts))


def decay_changes(memories: DataFrame, now, opts: DecayOptions = DecayOptions()) -> DataFrame:
    """How many rows ``decay`` would change."""
    old = F.col("importance")
    return memories.agg(F.count_if(old.isNull() | (F.abs(aged(now, opts) - old) > 1e-6)).alias("changed"))


def reset_base(memories: DataFrame, predicate, value: float) -> DataFrame:
    base = F.col("base_importance")
    return memories.withColumn("base_importance", F.when(predicate, F.lit(value)).otherwise(base))


class Settlement(NamedTuple):
    hot: DataFrame
    archived: DataFrame
    merged: DataFrame
    unsettled: DataFrame  # groups that would have settled but got no summary; their members stay hot


def _split(memories: DataFrame, rule: SettleRule, rows: DataFrame | None = None):
    """(member rows, rows of other tiers, rows of the target tier) of ``rows``, by default of all memories."""
    tier = F.col("tier")
    rows = memories if rows is None else rows
    members = rows.where(tier == rule.source_tier)
    rest = rows.where(tier.isNotNull() & ~tier.isin(rule.source_tier, rule.target_tier))
    untiered = rows.where(tier.isNull())
    if rule.adopt_untiered:
        having = memories.where(tier == rule.source_tier).select("user_id").distinct()
        members = members.unionByName(untiered.join(having, "user_id", "left_anti"))
        rest = rest.unionByName(untiered.join(having, "user_id", "left_semi"))
    else:
        rest = rest.unionByName(untiered)
    return members, rest, rows.where(tier == rule.target_tier)


def _scored(members: DataFrame, rule: SettleRule, now, opts: DecayOptions) -> DataFrame:
    return (
        members.withColumn("base", stored_base())
        .withColumn("importance", aged(now, opts))
        .withColumn("tier", F.lit(rule.source_tier))
        .withColumn("period", period_key("created_at", rule.period, now))
    )


def _groups(scored: DataFrame, rule: SettleRule) -> DataFrame:
    return (
        scored.groupBy(*GROUP)
        .agg(
            F.count_if(F.col("importance") < rule.threshold).alias("n_low"),
            F.count("*").alias("n_members"),
        )
        .where(F.col("n_low") >= rule.min_members)
    )


def settlement_groups(
    memories: DataFrame, rule: SettleRule, now, opts: DecayOptions = DecayOptions()
) -> DataFrame:
    """Per user and period how many members have faded, where that is enough to settle."""
    return _groups(_scored(_split(memories, rule)[0], rule, now, opts), rule)


def settle(
    memories: DataFrame,
    rule: SettleRule,
    now,
    reducer=None,
    embedder=None,
    semantic_target: bool = False,
    archive_band: str = "settled",
    decay_opts: DecayOptions = DecayOptions(),
    due: DataFrame | None = None,
    archive: DataFrame | None = None,
    max_raw: int = 10,
    max_merges: int = 3,
) -> Settlement:
    """Roll faded members up into one summary per period; originals go to the archive.

    The rows that have faded are numbered in their groups and written down once, and all that follows reads them there: their groups, texts, archive rows. What is
    small, one row per settling group, is worked out at once and written down too, so model calls run once, and Spark
    knows the sizes it joins. ``hot`` stays lazy: one scan of the table that meets the settled groups.
    Which members a summary has is told by ``archived`` (one row a member, with ``merged_into``) and by no list in the summary.
    Memories without a user never settle; their groups are listed in ``unsettled``.

    ``due`` (from ``read_due``) names the rows that may have faded; then nothing else is read but for ``hot``, and only
    ``rule.adopt_untiered`` looks up which users have the source tier. ``archive_band="below_shield"`` also copies the
    unsettled members below the shield to the archive.

    With the ``archive``, a summary that ``merge_plan`` wants rebuilt is made anew from its archived originals and the new members
    instead of from its own text, and counts as merged once; a summary that did not begin with archived members
    (it was a memory of that tier before) cannot be, and is merged.
    """
    reducer = reducer or extractive_reducer()
    embedder = embedder or hashing_embedder()
    members, rest, summaries = _split(memories, rule)
    scored = _scored(members, rule, now, decay_opts)
    fading = scored if due is None else _scored(_split(memories, rule, due)[0], rule, now, decay_opts)
    faded = F.col("importance") < rule.threshold
    low = number_rows(fading.where(faded), GROUP, ["created_at", "id"]).drop("group_rows")
    groups = stage(
        low.groupBy(*GROUP).agg(F.count("*").alias("n_low"), F.min("id").alias("first_id")).where(F.col("n_low") >= rule.min_members),
        "settle-groups",
    )
    low = low.join(groups.select(*GROUP, "first_id"), GROUP)

    text = leading_text(_as_members(low), 500, " ") if semantic_target else None
    if text is not None:
        text = text.withColumn("text", F.substring("text", 1, 500))
    target = find_merge_target(groups, memories, rule.target_tier, rule.period, now, text, embedder)
    target = stage(target, "settle-targets")

    existing = target.select(
        *GROUP,
        F.lit(0).cast("long").alias("position"),
        F.lit(0).alias("ord"),
        F.col("target.created_at").alias("created_at"),
        F.col("target.id").alias("id"),
        F.col("target.content").alias("content"),
        F.col("target.topics").alias("topics"),
        F.col("target.key_facts").alias("key_facts"),
        F.coalesce("target.base_importance", F.lit(0.5)).alias("base"),
        F.col("target.sentiment").alias("sentiment"),
    )
    parts = existing.unionByName(_as_members(low, "position"))
    merges = F.coalesce("target.merge_count", F.lit(0)) + 1
    if archive is not None:
        begun = archive.select("user_id", F.col("merged_into").alias("target_id"), F.col("id").alias("first_id"))
        plan = merge_plan(groups, memories, archive, rule, now, max_raw, max_merges).where("plan = 'rebuild'")
        own = plan.join(begun, ["user_id", "target_id"]).where(F.col("target_id") == _summary_id(rule))
        again = stage(own.select(*GROUP, "target_id", "plan").distinct(), "settle-rebuilt")
        kept = existing.join(again.select(*GROUP), GROUP, "left_anti")
        parts = kept.unionByName(_as_members(low, "position")).drop("position").unionByName(rebuild_members(again, archive))
        target = stage(target.join(again.select(*GROUP, "plan"), GROUP, "left"), "settle-planned")
        merges = F.when(F.col("plan").isNotNull(), 1).otherwise(merges)
    reduced = reducer(parts)
    born = F.concat(F.col("period"), F.lit("-01" if rule.period == "month" else "-01-01"))
    merged = (
        reduced.join(groups.select(*GROUP, "first_id"), GROUP)
        .join(target, GROUP, "left")
        .select(
            F.coalesce("target.id", _summary_id(rule)).alias("id"),
            "user_id",
            F.col("summary").alias("content"),
            "topics",
            "key_facts",
            "importance",
            F.col("importance").alias("base_importance"),
            "sentiment",
            F.lit("settlement").alias("source"),
            F.lit(rule.target_tier).alias("tier"),
            F.lit(0).alias("access_count"),
            instant(now).alias("last_accessed"),
            F.try_to_timestamp(born).alias("created_at"),
            F.concat(F.lit("settle-"), "period").alias("session_id"),
            F.col("target.parent_ids").alias("parent_ids"),
            merges.alias("merge_count"),
            "period",
        )
    )
    summaries_made = stage(embedder(merged, "content", "embedding"), "settle-merged")
    merged, done = conform(summaries_made), summaries_made.select(*GROUP, F.col("id").alias("_target"))
    flagged = scored.join(done, GROUP, "left")
    in_group = F.col("_target").isNotNull()
    replaced = merged.select("id")
    hot = (
        conform(flagged.where(~F.coalesce(in_group & faded, F.lit(False))))
        .unionByName(conform(rest))
        .unionByName(conform(summaries.join(replaced, "id", "left_anti")))
        .unionByName(merged)
    )
    gone = low.join(done, GROUP).withColumn("merged_into", F.col("_target"))
    if archive_band == "below_shield":
        between = flagged.where(in_group & ~faded & (F.col("importance") < rule.shield))
        gone = gone.unionByName(between.withColumn("merged_into", F.lit(None).cast("string")), allowMissingColumns=True)
    archived = gone.withColumn("archived_at", instant(now)).select(*MEMORY.names, "period", "merged_into", "archived_at")
    unsettled = groups.join(done.select(*GROUP), GROUP, "left_anti").drop("first_id")
    return Settlement(hot, archived, merged, unsettled)


def _summary_id(rule: SettleRule):
    """Named by the first member as well: late members of a period whose summary has moved on get one of their own."""
    return new_id("mem-", F.lit("settle"), "user_id", F.lit(rule.target_tier), "period", "first_id")


def _as_members(low: DataFrame, *more: str) -> DataFrame:
    return low.select(
        *GROUP, *more, F.lit(1).alias("ord"), "created_at", "id", "content", "topics", "key_facts", "base", "sentiment"
    )


class SessionEnd(NamedTuple):
    hot: DataFrame
    archived: DataFrame
    remembered: Remembered
    unsettled: DataFrame  # as in Settlement, of both steps, with their tier


def session_end(
    memories: DataFrame,
    rounds: DataFrame,
    now,
    summarizer=None,
    embedder=None,
    reducer=None,
    summary_opts: SummaryOptions = SummaryOptions(),
    decay_opts: DecayOptions = DecayOptions(),
    archive: DataFrame | None = None,
    consumed: DataFrame | None = None,
) -> SessionEnd:
    """Flush the rounds, age everything, settle days into months, then months into years.

    Over the append-only log, pass the ``archive`` and the ``consumed`` rounds of the earlier calls, and add
    ``remembered.consumed`` to the latter: what is already remembered, hot or archived, is not condensed again.

    The yearly step sees the months of the monthly step. Only new rows and the summary tiers
    are written on the way; the daily rows, the bulk of the table, pass straight through.
    """
    known = memories.select("id")
    if archive is not None:
        known = known.unionByName(archive.select("id"))
    remembered = summarize_batches(rounds, now, summarizer, embedder, summary_opts, consumed, known)
    new = stage(remembered.memories, "remembered")
    start = decay(conform(memories).unionByName(new), now, decay_opts)
    monthly = settle(start, DAILY_TO_MONTHLY, now, reducer, embedder, decay_opts=decay_opts)
    is_summary = F.coalesce(F.col("tier").isin("monthly", "yearly"), F.lit(False))
    summaries = stage(monthly.hot.where(is_summary), "summaries")
    yearly = settle(summaries, MONTHLY_TO_YEARLY, now, reducer, embedder, decay_opts=decay_opts)
    return SessionEnd(
        monthly.hot.where(~is_summary).unionByName(yearly.hot),
        monthly.archived.unionByName(yearly.archived),
        remembered._replace(memories=new),
        monthly.unsettled.withColumn("tier", F.lit("daily")).unionByName(yearly.unsettled.withColumn("tier", F.lit("monthly"))),
    )


def merge_plan(groups: DataFrame, summaries: DataFrame, archive: DataFrame, rule: SettleRule, now,
               max_raw: int = 10, max_merges: int = 3) -> DataFrame:
    """Per group, merge incrementally or rebuild from the originals.

    Adds raw (originals behind the summary plus the new members), merges and plan.
    Originals are counted in the archive, which knows each one's summary.
    """
    dated = find_merge_target(groups, summaries, rule.target_tier, rule.period, now)
    raw = archive.groupBy(F.col("merged_into").alias("id")).agg(F.count("*").alias("_raw"))
    known = dated.select(*GROUP, F.col("target.id").alias("id"),
                         F.coalesce("target.merge_count", F.lit(0)).alias("merges")).join(raw, "id", "left")
    total = F.coalesce("_raw", F.lit(0)) + F.col("n_low")
    merges = F.coalesce("merges", F.lit(0))
    fits = (total < max_raw) & (merges < max_merges)
    return groups.join(known, GROUP, "left").select(
        *GROUP, F.col("id").alias("target_id"), total.alias("raw"), merges.alias("merges"),
        F.when(fits, "incremental").otherwise("rebuild").alias("plan"),
    )


def rebuild_members(plan: DataFrame, archive: DataFrame) -> DataFrame:
    """The archived originals of every summary that is to be rebuilt, as reducer members."""
    wanted = plan.where((F.col("plan") == "rebuild") & F.col("target_id").isNotNull())
    originals = archive.drop("period").join(
        wanted.select("user_id", "period", F.col("target_id").alias("merged_into")), ["user_id", "merged_into"]
    )
    return _as_members(originals.withColumn("base", stored_base()))
