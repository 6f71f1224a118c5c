"""Typing of raw model replies: JSON, fenced JSON, or fields picked out of loose text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import computed
from .expr import strip_text, whole_json

# What a reply without the field gets.
DEFAULT_SUMMARY = "Conversation record"
DEFAULT_SENTIMENT = "neutral"
DEFAULT_IMPORTANCE = 0.5
DEFAULT_TOPIC = "general"

# Where loose text keeps its fields.
LOOSE_TEXT = r'"{}"\s*:\s*"([^"]+)"'
LOOSE_LIST = r'"{}"\s*:\s*\[([^\]]+)\]'
LOOSE_NUMBER = r'"{}"\s*:\s*([0-9.]+)'


def _unfenced(raw: Column) -> Column:
    text = bare = strip_text(raw)
    for pattern in (r"\A```json\s*", r"\A```\s*", r"\s*```\n?\z"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.when(text.contains("```"), bare).otherwise(text)


def _found(raw: Column, pattern: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(raw, pattern.format(name), 1), F.lit(""))


def parse_replies(df: DataFrame, raw: str = "raw", max_topics: int = 5, max_facts: int = 5) -> DataFrame:
    """Add ``route`` (json, fenced, loose), ``problem`` (NULL when usable) and the typed fields."""
    text, none = F.col(raw), F.array().cast("array<string>")
    loose = F.col("route") == "loose"

    def documents(direct: Column) -> list[Column]:
        fenced = F.when(direct.isNull(), whole_json(_unfenced(text)))
        return [direct.alias("_direct"), fenced.alias("_fenced")]

    def routes(doc: Column) -> list[Column]:
        is_object = F.schema_of_variant(doc).startswith("OBJECT")
        return [
            F.when(F.col("_direct").isNotNull(), "json").when(doc.isNotNull(), "fenced").otherwise("loose").alias("route"),
            F.when(is_object, doc).alias("_doc"),
        ]

    def scores(number: Column) -> list[Column]:
        value = F.when(number == "true", "1").when(number == "false", "0").otherwise(number)
        given = number.isNotNull() | F.try_variant_get("_doc", "$.importance", "variant").isNotNull()
        return [F.when(given, value.try_cast("double")).otherwise(F.lit(DEFAULT_IMPORTANCE)).alias("_score")]

    def fields(doc: Column) -> list[Column]:
        def got(name: str, kind: str) -> Column:
            return F.try_variant_get(doc, f"$.{name}", kind)

        def string(name: str, default: str) -> Column:
            said = F.when(loose, _found(text, LOOSE_TEXT, name)).otherwise(got(name, "string"))
            return F.coalesce(said, F.lit(default)).alias(name)

        def wrong(name: str, kind: str) -> Column:
            return ~F.schema_of_variant(got(name, "variant")).startswith(kind)

        listed = F.transform(
            F.split(_found(text, LOOSE_LIST, "topics"), ","), lambda t: F.regexp_replace(strip_text(t), '^"+|"+$', "")
        )
        topics = F.when(loose, F.coalesce(listed, F.array(F.lit(DEFAULT_TOPIC)))).otherwise(got("topics", "array<string>"))
        score = F.col("_score")
        problem = (
            F.when(text.isNull(), "no reply")
            .when(~loose & doc.isNull(), "not an object")
            .when(wrong("topics", "ARRAY"), "topics not a list")
            .when(wrong("key_facts", "ARRAY"), "key_facts not a list")
            .when(wrong("summary", "STRING"), "summary not text")
            .when(wrong("sentiment", "STRING"), "sentiment not text")
            .when(score.isNull() | F.isnan(score), "importance not a number")
            .when((score < 0) | (score > 1), "importance out of range")
        )
        return [
            problem.alias("problem"),
            string("summary", DEFAULT_SUMMARY),
            F.slice(F.coalesce(topics, none), 1, max_topics).alias("topics"),
            F.slice(F.coalesce(got("key_facts", "array<string>"), none), 1, max_facts).alias("key_facts"),
            string("sentiment", DEFAULT_SENTIMENT),
            score.alias("importance"),
        ]

    df = computed(df, whole_json(raw), documents)
    df = computed(df, F.coalesce("_direct", "_fenced"), routes)
    in_doc = strip_text(F.try_variant_get("_doc", "$.importance", "string"))
    df = computed(df, F.when(loose, _found(text, LOOSE_NUMBER, "importance")).otherwise(in_doc), scores)
    return computed(df, F.col("_doc"), fields).drop("_direct", "_fenced", "_doc", "_score")


def ingest_responses(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable replies, quarantined replies with their problem, number of usable replies by route)."""
    parsed = parse_replies(df, raw)
    good = parsed.where(F.col("problem").isNull()).drop("problem")
    bad = parsed.where(F.col("problem").isNotNull()).select(*df.columns, "route", "problem")
    return good, bad, good.groupBy("route").agg(F.count("*").alias("replies"))
