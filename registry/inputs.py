"""The engine's input shapes, derived from the given tables: whole tables, whole texts.

User 0 owns about three eighths of every shape, so each query meets a hot key.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmem.schema import conform

NOW = "2024-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owner(column: str):
    c = F.col(column)
    return F.when(c % 3 == 0, F.lit(0)).otherwise(c % 16).cast("long")


def _day(offset):
    return F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=offset.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    n, user = F.col("doc_id"), owner("doc_id")
    slot = n % 10
    tier = F.when(slot == 9, "yearly").when(slot == 8, "monthly").when(user == 5, None).otherwise("daily")
    created = _day(n % 180)
    return conform(
        d.join(e, d.doc_id == e.vec_id, "left").select(
            F.concat(F.lit("mem-"), n.cast("string")).alias("id"),
            user.alias("user_id"),
            F.col("text").alias("content"),
            "embedding",
            F.array("lang", "source").alias("topics"),
            F.array(F.concat(F.col("source"), F.lit("-"), (n % 7).cast("string"))).alias("key_facts"),
            ((n * 53) % 100).cast("double").__truediv__(100).alias("importance"),
            ((n * 37) % 100).cast("double").__truediv__(100).alias("base_importance"),
            F.when(n % 4 == 0, "positive").when(n % 4 == 1, "negative").otherwise("neutral").alias("sentiment"),
            F.lit("auto_summary").alias("source"),
            tier.alias("tier"),
            (n % 12).cast("int").alias("access_count"),
            created.alias("last_accessed"),
            created.alias("created_at"),
            F.concat(F.lit("session-"), (n % 50).cast("string")).alias("session_id"),
        )
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), owner("vec_id").alias("user_id"), F.col("embedding").alias("q_embedding")
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    minute = F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
    return (
        table(spark, sf_dir, "conversations")
        .select(
            "conv_id", "turn", "role", F.col("text").alias("user_text"),
            F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)).alias("reply"),
        )
        .where(F.col("role") == "user")
        .select(
            owner("conv_id").alias("user_id"),
            F.col("conv_id").cast("string").alias("conv_id"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("round_id"),
            "user_text",
            F.coalesce("reply", F.lit("")).alias("assistant_text"),
            (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + minute).alias("ts"),
        )
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        owner("doc_id").alias("user_id"),
        F.concat(F.lit("note"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall hits to tally. Ids without a memory are intended."""
    number = (F.col("user_id") * 31 + F.col("event_id")) % 2000
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("mem-"), number.cast("string")).alias("id"), F.col("ts").alias("hit_at")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies of every kind around the text of each document."""
    safe = F.regexp_replace("text", r'[\x00-\x1f"\\]', " ")
    kind = F.col("doc_id") % 8

    def around(before: str, after: str):
        return F.concat(F.lit(before), safe, F.lit(after))

    raw = (
        F.when(kind == 0, around('{"summary":"', '","topics":["a","b","c","d","e","f"],"importance":0.7}'))
        .when(kind == 1, around('```json\n{"summary":"', '","key_facts":["k"],"sentiment":"positive"}\n```'))
        .when(kind == 2, around('note: "summary": "', '", "importance": 0.3, "topics": ["x", "y z"]'))
        .when(kind == 3, around('["', '"]'))
        .when(kind == 4, around('{"summary":"', '","topics":null}'))
        .when(kind == 5, around('{"summary":"', '","importance":1.5}'))
        .when(kind == 6, around('{"summary":"', '","importance":"0.25"}'))
        .otherwise(around("", ""))
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per conversation: text as a string or as parts, with meta and broken lines between."""
    turn = F.col("turn")
    part = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                   F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), (turn % 5 == 4).alias("isMeta"),
                               F.struct(F.col("text").alias("content")).alias("message")))
    parts = F.to_json(F.struct(F.col("role").alias("type"), F.lit(False).alias("isMeta"),
                               F.struct(part.alias("content")).alias("message")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("transcript"), turn.alias("line_no"),
        F.when(turn % 7 == 6, F.lit("{broken")).when(F.col("conv_id") % 2 == 0, plain).otherwise(parts).alias("value"),
    )
