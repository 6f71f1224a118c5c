"""Fixed schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("key_facts", T.ArrayType(T.StringType())),
        T.StructField("importance", T.DoubleType()),
        T.StructField("base_importance", T.DoubleType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("access_count", T.IntegerType()),
        T.StructField("last_accessed", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("parent_ids", T.ArrayType(T.StringType())),
        T.StructField("merge_count", T.IntegerType()),
    ]
)

# A round as it is logged: one JSON object per line, the time as an ISO string.
ROUND_LINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("conv_id", T.StringType()),
        T.StructField("round", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("assistant", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# A round inside the engine.
ROUND = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("conv_id", T.StringType()),
        T.StructField("round_id", T.StringType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("assistant_text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def conform(df, schema=MEMORY):
    """Select the columns of ``schema`` in order; missing ones become NULL."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
