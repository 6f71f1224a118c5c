"""Which memories became which summary, as edges; no row ever lists its members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def lineage_edges(archive: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(id, merged_into) of every archived memory that went into a summary.

    ``summaries`` adds the edges of rows that still list their ``parent_ids``, as tables written by earlier versions do.
    """
    edges = archive.where(F.col("merged_into").isNotNull()).select("id", "merged_into")
    if summaries is not None:
        listed = summaries.select(F.explode("parent_ids").alias("id"), F.col("id").alias("merged_into"))
        edges = edges.unionByName(listed)
    return edges.distinct()


def last_summaries(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, merged_into, steps): the summary each memory has ended in, through summaries of summaries, and how many there are on the way.

    Pointer jumping: a round replaces each summary by the one it is known to have gone into, so 2^k levels take k rounds.
    A round joins on the summary, of which there is one row each; only ids that are summaries themselves take part on that
    side. A memory with several edges keeps each. Edges that lead in a circle raise after ``max_rounds``.
    """
    up = stage(edges.select("id", "merged_into", F.lit(1).cast("long").alias("steps")), "lineage")
    for _ in range(max_rounds):
        hops = up.join(up.select(F.col("merged_into").alias("id")).distinct(), "id", "left_semi").select(
            F.col("id").alias("merged_into"), F.col("merged_into").alias("_next"), F.col("steps").alias("_more")
        )
        jumped = stage(up.join(hops, "merged_into", "left"), "lineage")
        if jumped.where(F.col("_next").isNotNull()).isEmpty():
            return up
        up = jumped.select("id", F.coalesce("_next", "merged_into").alias("merged_into"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
    raise ValueError("the edges lead in a circle")


def originals(edges: DataFrame) -> DataFrame:
    """(summary, id, steps) of every memory that is no summary of others itself, under the last summary it has ended in."""
    made = edges.select(F.col("merged_into").alias("id")).distinct()
    return last_summaries(edges).join(made, "id", "left_anti").select(F.col("merged_into").alias("summary"), "id", "steps")
