"""Folding the members of a settlement group into one bounded summary.

A reducer takes the member rows (user_id, period, ord, created_at, id, content, topics,
key_facts, base, sentiment; ord 0 is the existing summary; where there is a ``position``, it is the place in that order) and returns one row per
(user_id, period) with summary, topics, key_facts, sentiment, importance. A group it returns no row for stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.responses import parse_replies
from ..sources.staging import stage
from .ordering import leading_rows, null_safe_join, number_rows, top_rows
from .salience import best_first, counted_words, least_room, number_of, place_of, room, sentence_rows, sentences, weight, word_rows

GROUP = ["user_id", "period"]
MEMBER_ORDER = ["ord", "created_at", "id"]
#: Rows whose lengths are summed up together; even, so that no pair is parted.
_BLOCK = 1024


def leading_text(members: DataFrame, budget: int, joiner: str = "\n") -> DataFrame:
    """Contents of each group in member order, joined: at least the first ``budget`` characters."""
    rows = members.select(*GROUP, *MEMBER_ORDER, F.coalesce("content", F.lit("")).alias("content"))
    size = F.length("content") + len(joiner)
    head = leading_rows(rows, GROUP, MEMBER_ORDER, size, budget + 1, ["id"])
    ordered = F.sort_array(F.collect_list(F.struct(*MEMBER_ORDER, "content"))).getField("content")
    return head.groupBy(*GROUP).agg(F.array_join(ordered, joiner).alias("text"))


def salient_text(members: DataFrame, max_chars: int, joiner: str = "\n") -> DataFrame:
    """What the members (numbered by ``position``) of each group say, in at most ``max_chars`` characters: (user_id, period, text).

    Every member is read in full. Words are counted over the group before they meet, a group's sentences are cut to the
    budget in salted parts, and only the chosen ones are joined to their members; sentences of a member are joined by a space,
    members by ``joiner``. Members without content add nothing.

    A sentence that adds no word is chosen only after all that add one, so it and all sentences before it have to fit: such sentences
    are looked for at the head of a group and nowhere else. What is chosen is bounded by ``max_chars`` a group and written down, so
    the members are not dealt out to meet it.
    """
    said = members.select(*GROUP, "position", sentences("content").alias("said"))
    counted = counted_words(word_rows(said, GROUP, "position", "said", marks=False), GROUP)
    slim = members.select(*GROUP, "position", least_room("content").alias("_least"))
    head = leading_rows(slim, GROUP, ["position"], F.col("_least"), max_chars + 1, ["position"]).select(*GROUP, "position")
    head = null_safe_join(members.select(*GROUP, "position", "content"), stage(head, "merge-head"), [*GROUP, "position"])
    fill = sentence_rows(head.select(*GROUP, "position", sentences("content").alias("said")), GROUP, "position", "said")
    rows = counted.select(*GROUP, "key", weight().alias("weight")).unionByName(fill.select(*GROUP, "key", F.lit(0).alias("weight")))
    scored = rows.groupBy(*GROUP, "key").agg(F.sum("weight").alias("score"))
    best = leading_rows(scored, GROUP, best_first(), room(), max_chars, ["key"])
    chosen = best.where(F.col("_before") + room() <= max_chars + 1).withColumn("position", place_of())
    chosen = stage(chosen.groupBy(*GROUP, "position").agg(F.sort_array(F.collect_list("key")).alias("keys")), "merge-chosen")
    found = null_safe_join(members.select(*GROUP, "position", "content"), chosen, [*GROUP, "position"])
    shown = found.select(*GROUP, "position", "keys", sentences("content").alias("said")).select(
        *GROUP, "position", F.array_join(F.transform("keys", lambda k: F.get("said", number_of(k))), " ").alias("line")
    )
    lines = F.sort_array(F.collect_list(F.struct("position", "line"))).getField("line")
    return shown.groupBy(*GROUP).agg(F.array_join(lines, joiner).alias("text"))


def extractive_reducer(max_chars: int = 8000, max_topics: int = 5, max_facts: int = 5):
    """The sentences that say most of what all members say, in order and at most ``max_chars`` together; the first distinct topics
    and facts, the mean base and the most frequent sentiment."""

    def reduce(members: DataFrame) -> DataFrame:
        if "position" not in members.columns:
            members = number_rows(members, GROUP, MEMBER_ORDER)  # written down: all that follows reads it
        text = salient_text(members, max_chars).withColumnRenamed("text", "summary")
        feel = F.coalesce("sentiment", F.lit("neutral"))
        stats = (
            members.groupBy(*GROUP, feel.alias("sentiment"))
            .agg(F.count("*").alias("n"), F.sum(F.col("base").cast("decimal(18,8)")).alias("base"))
            .groupBy(*GROUP)
            .agg(
                F.round(F.sum("base").cast("double") / F.sum("n"), 4).alias("importance"),
                F.min(F.struct((-F.col("n")).alias("n"), "sentiment"))["sentiment"].alias("sentiment"),
            )
        )

        def listed(kind: str, column: str):
            items = F.coalesce(column, F.array().cast("array<string>"))
            return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("item")))

        items = members.select(
            *GROUP, *MEMBER_ORDER,
            F.explode(F.concat(listed("topics", "topics"), listed("key_facts", "key_facts"))).alias("x"),
        ).select(*GROUP, *MEMBER_ORDER, "x.*")
        firsts = items.groupBy(*GROUP, "kind", "item").agg(F.min(F.struct(*MEMBER_ORDER, "pos")).alias("at"))
        kept = top_rows(firsts, [*GROUP, "kind"], ["at"], max(max_topics, max_facts))

        def gathered(kind: str, n: int):
            mine = F.when((F.col("kind") == kind) & (F.col("rank") <= n), F.struct("rank", "item"))
            return F.sort_array(F.collect_list(mine)).getField("item").alias(kind)

        lists = kept.groupBy(*GROUP).agg(gathered("topics", max_topics), gathered("key_facts", max_facts))
        none = F.array().cast("array<string>")
        return (
            stats.join(text, GROUP, "left")
            .join(lists, GROUP, "left")
            .select(
                *GROUP, F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("topics", none).alias("topics"),
                F.coalesce("key_facts", none).alias("key_facts"), "sentiment", "importance",
            )
        )

    return reduce


def model_reducer(summarizer, max_chars: int = 8000):
    """A reducer from a summarizer. Members are merged in their order in texts of about ``max_chars``, the results
    merged again in theirs until one per group is left: an ordered tree, the same for any cluster. So every member is
    read, with all its fields. A group that gets an unusable reply at any level has no row; the others go on."""

    def reduce(members: DataFrame) -> DataFrame:
        level = members.select(
            *GROUP, *MEMBER_ORDER, F.coalesce("content", F.lit("")).alias("content"), "topics", "key_facts",
            F.col("base").alias("importance"), "sentiment",
        )
        while True:
            level = stage(_packed(level, max_chars), "merge-texts")
            replies = stage(parse_replies(summarizer(level)), "merge-replies")
            broken = replies.where(F.col("problem").isNotNull() | F.col("summary").isNull())
            merged = stage(replies.join(broken.select(*GROUP).distinct(), GROUP, "left_anti"), "merge-usable")
            if merged.groupBy(*GROUP).count().where("count > 1").isEmpty():
                return merged.select(*GROUP, "summary", "topics", "key_facts", "sentiment", "importance")
            level = merged.select(
                *GROUP, "ord", F.timestamp_seconds("place").alias("created_at"), F.col("batch_id").alias("id"),
                F.col("summary").alias("content"), "topics", "key_facts", "importance", "sentiment",
            )

    return reduce


def _packed(rows: DataFrame, max_chars: int) -> DataFrame:
    """Texts of about ``max_chars`` in the order of the rows; a longer row still shares its text with the next.

    Which rows meet follows from their order and lengths alone: lengths are summed up per block of rows, blocks per group.
    """
    none = F.array().cast("array<string>")
    line = F.concat(
        F.when(F.col("ord") == 0, F.lit("- [existing summary] ")).otherwise(F.lit("- ")), F.col("content"),
        F.lit("\n  topics: "), F.array_join(F.coalesce("topics", none), ", "),
        F.lit("\n  key facts: "), F.array_join(F.coalesce("key_facts", none), "; "),
        F.lit("\n  importance: "), F.coalesce(F.col("importance").cast("string"), F.lit("")),
        F.lit("\n  sentiment: "), F.coalesce("sentiment", F.lit("neutral")),
    )
    sized = number_rows(rows, GROUP, MEMBER_ORDER).withColumn("line", line).withColumns({
        "_len": F.length("line") + 1, "_block": F.floor((F.col("position") - 1) / _BLOCK), "_pair": F.floor((F.col("position") - 1) / 2),
    })
    earlier = Window.partitionBy(*GROUP).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy(*GROUP, "_block").agg(F.sum("_len").alias("_sum"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*GROUP, "_block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    packed = null_safe_join(sized, blocks, [*GROUP, "_block"]).withColumn(
        "_size", F.floor((F.col("_before") + F.coalesce(F.sum("_len").over(inside), F.lit(0))) / max_chars)
    )
    # Two rows at least share a text, so each level halves a group whatever the lengths. A pair lies in one block.
    packed = packed.withColumn("_pack", F.min("_size").over(Window.partitionBy(*GROUP, "_block", "_pair")))
    ordered = F.sort_array(F.collect_list(F.struct("position", "line"))).getField("line")
    return (
        packed.groupBy(*GROUP, "_pack")
        .agg(F.min("ord").alias("ord"), F.min("position").alias("place"), F.array_join(ordered, "\n").alias("text"))
        .select(*GROUP, "ord", "place", "text", F.concat_ws("/", F.col("user_id").cast("string"), "period", F.sha2("text", 256), F.col("place").cast("string")).alias("batch_id"))
    )
