"""From logged rounds to the texts that are condensed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import computed
from ..functions.expr import new_id, strip_text, truncate_marked, whole_json
from ..options import SummaryOptions
from .ordering import number_rows

CONVERSATION = ["user_id", "conv_id"]


def round_batches(rounds: DataFrame, every: int = 10) -> DataFrame:
    """Number the rounds of each conversation and cut them into batches of ``every``.

    ``flush`` marks the last, short batch: the one a session end would force out.
    """
    size = F.least(F.lit(every), F.col("group_rows") - F.col("batch_no") * every)
    return (
        number_rows(rounds, CONVERSATION, ["ts", "round_id"])
        .withColumnRenamed("position", "round")
        .withColumn("batch_no", F.floor((F.col("round") - 1) / every).cast("long"))
        .withColumn("batch_size", size.cast("int"))
        .withColumn("flush", F.col("batch_size") < every)
        .drop("group_rows")
    )


def with_batch_id(batches: DataFrame) -> DataFrame:
    """Key the batches by their place, first and last round: one that has grown since, or is numbered anew, is another."""
    batch = Window.partitionBy(*CONVERSATION, "batch_no")
    ends = {"_first": F.min_by("round_id", "round").over(batch), "_last": F.max_by("round_id", "round").over(batch)}
    key = new_id("batch-", *CONVERSATION, "batch_no", "_first", "_last")
    return batches.withColumns(ends).withColumn("batch_id", key).drop(*ends)


def without_consumed(rounds: DataFrame, consumed: DataFrame) -> DataFrame:
    """The rounds not listed in ``consumed`` (user_id, conv_id, round_id). Rounds without an id are never listed."""
    done = consumed.select(*[F.col(c).alias(f"_done_{c}") for c in (*CONVERSATION, "round_id")])
    same = rounds["round_id"] == done["_done_round_id"]
    for c in CONVERSATION:
        same = same & rounds[c].eqNullSafe(done[f"_done_{c}"])
    return rounds.join(done, same, "left_anti")


def assemble_conversation(batches: DataFrame, opts: SummaryOptions = SummaryOptions()) -> DataFrame:
    """One text per batch, rounds in order, one line per non-empty message.

    Grouped by what numbered the batches as well, so the rounds are not dealt out again.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")

    def line(label: str, column: str):
        said = strip_text(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\n", " "))
        return F.when(said != "", F.concat(F.lit(f"[{label} | "), stamp, F.lit("] - "), said))

    lines = F.concat_ws("\n", line(opts.user_label, "user_text"), line(opts.assistant_label, "assistant_text"))
    rows = batches.select("batch_id", *CONVERSATION, "batch_no", "batch_size", "flush", "ts", "round",
                          F.nullif(lines, F.lit("")).alias("lines"))
    ordered = F.sort_array(F.collect_list(F.struct("round", "lines"))).getField("lines")
    return rows.groupBy("batch_id", *CONVERSATION, "batch_no").agg(
        *[F.any_value(c).alias(c) for c in ("batch_size", "flush")],
        F.min("ts").alias("first_ts"),
        truncate_marked(F.array_join(ordered, "\n"), opts.max_chars, opts.cut_marker).alias("text"),
    )


def last_user_message(lines: DataFrame) -> DataFrame:
    """Per transcript, the text of the last real user line; (transcript, line_no, value) in.

    Content is a string, or a list whose first text part counts; meta lines, broken
    lines and lines without text are passed over.
    """

    def user_text(doc):
        content = F.try_variant_get(doc, "$.message.content", "variant")
        kind = F.schema_of_variant(content)
        parts = F.filter(
            F.try_variant_get(doc, "$.message.content", "array<variant>"),
            lambda p: F.try_variant_get(p, "$.type", "string") == "text",
        )
        said = F.when(kind == "STRING", F.try_variant_get(doc, "$.message.content", "string")).when(
            kind.startswith("ARRAY"), F.try_variant_get(F.get(parts, F.lit(0)), "$.text", "string")
        )
        meta = F.coalesce(F.try_variant_get(doc, "$.isMeta", "string"), F.lit("false"))
        of_user = (F.try_variant_get(doc, "$.type", "string") == "user") & meta.isin("false", "0", "")
        return [F.when(of_user, strip_text(said)).alias("text")]

    return (
        computed(lines, whole_json("value"), user_text)
        .where(F.col("text") != "")
        .groupBy("transcript")
        .agg(F.max_by("text", "line_no").alias("last_user"))
    )
