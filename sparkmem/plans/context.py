"""The recent memories given at the start of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import memory_line, strip_text
from ..operators.ordering import leading_rows, top_rows
from ..options import ContextOptions, DecayOptions
from .lifecycle import decay


def recent(memories: DataFrame, n: int = 20) -> DataFrame:
    """The n newest memories per user; ``age_rank`` 1 is the newest. Show them by age_rank descending."""
    return top_rows(memories, ["user_id"], [F.desc("created_at"), F.col("id")], n, "age_rank")


def pack_context(memories: DataFrame, opts: ContextOptions = ContextOptions()) -> DataFrame:
    """Per user the newest memories whose joined lines fit the budget, oldest first, then the guide.

    If not even the newest fits, its line is cut to the budget.
    """
    budget = opts.budget
    line = strip_text(memory_line("created_at", "importance", "access_count", "base_importance", "content"))
    rows = memories.select("user_id", "id", "created_at", line.alias("line"))
    size = F.length("line") + 2
    newest = [F.desc("created_at"), F.col("id")]
    head = leading_rows(rows, ["user_id"], newest, size, budget, ["id"])
    kept = head.where((F.col("_before") + size <= budget + 2) | (F.col("_before") == 0))
    fitted = F.when(
        F.length("line") > budget, F.regexp_replace(F.substring("line", 1, budget), r"(?U)\s+\z", "")
    ).otherwise(F.col("line"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_before")).alias("at"), fitted.alias("line"))))
    text = F.array_join(ordered.getField("line"), "\n\n")
    return kept.groupBy("user_id").agg(F.count("*").alias("memories"), text.alias("text")).select(
        "user_id",
        "memories",
        F.when(F.col("text") == "", F.lit(opts.guide))
        .otherwise(F.concat("text", F.lit("\n\n" + opts.guide)))
        .alias("context"),
    )


def session_start(
    memories: DataFrame, now, opts: ContextOptions = ContextOptions(), decay_opts: DecayOptions = DecayOptions()
) -> DataFrame:
    """Age the memories, take the most recent per user and pack them."""
    return pack_context(recent(decay(memories, now, decay_opts), opts.recent), opts)
