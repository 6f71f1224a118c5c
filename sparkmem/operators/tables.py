"""Keyed changes to the memory table. Each returns the new version; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import null_empty, period_key
from ..sources.staging import stage
from .search import knn


def _one_per_id(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per id with the fields as ``_new_*``; grouped by the key of the join that follows, so no shuffle of its own."""
    return null_empty(rows).groupBy("id").agg(*[F.max(c).alias(f"_new_{c}") for c in fields])


def update_metadata(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """Per id, non-empty fields overwrite; unknown ids are ignored. Of several updates of an id, each field's largest value counts."""
    fields = [c for c in updates.columns if c != "id"]
    new = _one_per_id(updates, fields)
    joined = memories.join(new, "id", "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{f.name}").cast(f.dataType), F.col(f.name)).alias(f.name)
            if f.name in fields
            else F.col(f.name)
            for f in memories.schema.fields
        ]
    )


def upsert(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert rows, or overwrite the non-empty fields of those whose id exists. Of several rows of an id, each field's largest value counts."""
    fields = [c for c in rows.columns if c != "id"]
    new = _one_per_id(rows, fields)
    joined = memories.join(new, "id", "full_outer")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{f.name}").cast(f.dataType), F.col(f.name)).alias(f.name)
            if f.name in fields
            else F.col(f.name)
            for f in memories.schema.fields
        ]
    )


def delete_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def all_memories(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Hot and archived rows in one view, told apart by ``archived``."""
    return hot.withColumn("archived", F.lit(False)).unionByName(
        archive.withColumn("archived", F.lit(True)), allowMissingColumns=True
    )


def count_memories(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("memories"))


def access_tally(hits: DataFrame, hit_at: str = "hit_at") -> DataFrame:
    return hits.groupBy("id").agg(F.count("*").alias("hits"), F.max(hit_at).alias("last_hit"))


def apply_increments(memories: DataFrame, increments: DataFrame) -> DataFrame:
    """Add up increments (id, hits, last_hit, importance) of any number of batches; unknown ids are ignored.

    Importance is what the latest hit saw, of several at one time the largest.
    """
    latest = F.struct("last_hit", "importance")
    gained = increments.groupBy("id").agg(F.sum("hits").alias("_hits"), F.max(latest).alias("_last"))
    hit = F.col("_hits").isNotNull()
    count = (F.coalesce("access_count", F.lit(0)) + F.col("_hits")).cast(memories.schema["access_count"].dataType)
    return (
        memories.join(gained, "id", "left")
        .withColumns({
            "access_count": F.when(hit, count).otherwise(F.col("access_count")),
            "last_accessed": F.greatest("last_accessed", "_last.last_hit"),
            "importance": F.coalesce("_last.importance", "importance"),
        })
        .select(*memories.columns)
    )


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Match groups (user_id, period) to summaries (id), each at most once, nearest pairs first.

    A round takes every pair that is the nearest left to both its group and its summary, in the order (distance, period, id); what it
    takes is what going through all pairs by that order would. A group has few pairs, so the table shrinks fast.
    """
    order = F.struct("distance", "period", "id")
    taken = None
    while True:
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            return pairs.select("user_id", "period", "id") if taken is None else taken
        by_group = pairs.groupBy("user_id", "period").agg(F.min(order).alias("_mine"))
        by_id = pairs.groupBy("user_id", "id").agg(F.min(order).alias("_its"))
        best = by_group.join(by_id, (by_group["user_id"] == by_id["user_id"]) & (F.col("_mine.id") == by_id["id"]) & (F.col("_mine") == F.col("_its")))
        best = stage(best.select(by_group["user_id"], "period", F.col("_mine.id").alias("id")), "matched")
        taken = best if taken is None else taken.unionByName(best)
        pairs = pairs.join(best.select("user_id", "period"), ["user_id", "period"], "left_anti").join(best.select("user_id", "id"), ["user_id", "id"], "left_anti")


def find_merge_target(
    groups: DataFrame,
    memories: DataFrame,
    tier: str,
    period: str,
    now,
    query_text: DataFrame | None = None,
    embedder=None,
    max_distance: float = 0.25,
) -> DataFrame:
    """The existing summary each (user_id, period) group merges into, as struct ``target``.

    First choice is a row of ``tier`` dated in the period (earliest, then by id). With
    ``query_text`` (user_id, period, text) groups left over take a row of ``tier`` among
    their three nearest memories, if near enough. A row is the target of one group: the nearest pairs are matched first (``one_to_one``).
    """
    keep = [c for c in memories.columns if c not in ("user_id", "embedding")]
    dated = (
        memories.where(F.col("tier") == tier)
        .withColumn("period", period_key("created_at", period, now))
        .join(groups.select("user_id", "period"), ["user_id", "period"])
        .groupBy("user_id", "period")
        .agg(F.min_by(F.struct(*keep), F.struct("created_at", "id")).alias("target"))
    )
    if query_text is None:
        return dated
    open_groups = groups.select("user_id", "period").join(dated, ["user_id", "period"], "left_anti")
    asked = embedder(query_text.join(open_groups, ["user_id", "period"]), "text", "q_embedding").withColumn(
        "query_id", F.concat_ws("/", F.col("user_id").cast("string"), "period")
    )
    asked = stage(asked, "asked")  # read several times: the model is called once
    near = knn(asked, memories, 3, carry=("tier",)).where((F.col("tier") == tier) & (F.col("distance") < max_distance))
    free = near.join(dated.select(F.col("target.id").alias("id")), "id", "left_anti")
    pairs = asked.select("query_id", "user_id", "period").join(free.select("query_id", "id", "distance"), "query_id")
    free = one_to_one(pairs.select("user_id", "period", "id", "distance"))
    rows = memories.where(F.col("tier") == tier).select("id", F.struct(*keep).alias("target"))
    return dated.unionByName(rows.join(free, "id").select("user_id", "period", "target"))
