"""The two pluggable model calls, text → reply and text → vector, and their built-in defaults.

A summarizer adds the column ``raw``, one reply per row, to a DataFrame with ``text``; an
embedder is ``(DataFrame, text column, output column) → DataFrame``. The defaults are deterministic
and need no Python worker.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.salience import WORD, best_first, counted_words, is_word, number_of, room, sentences, weight, word_rows
from ..sources.staging import stage
from .binding import computed, unused
from .expr import l2_normalize

_FIRST_SENTENCE = r"^[^.!?。！？]*[.!?。！？]?"
#: Letters a topic has at least.
_TOPIC = 4


def extractive_summarizer(
    user_label: str = "user", max_chars: int = 500, max_topics: int = 5, max_facts: int = 5
):
    """The sentences of the user's messages that say most of what all of them say, in order and at most ``max_chars`` together;
    the most frequent words as topics, the first sentences of the first messages as facts.

    Text without user lines (a note) counts line by line. All sentences of all messages compete. Texts are named by
    ``batch_id``; each is counted and ranked in its own row, and no word of it is shuffled. Texts that share their name, or have none,
    are counted together, which takes a shuffle of their words.
    """
    mark = f"[{user_label} | "

    def messages(lines):
        said = F.filter(lines, lambda x: x.startswith(mark))
        spoken = F.transform(said, lambda x: F.substring(x, F.locate("] - ", x) + F.lit(4), F.length(x)))
        return [F.when(F.size(said) > 0, spoken).otherwise(lines).alias("_said")]

    def summarize(batches: DataFrame) -> DataFrame:
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        shared = batches.groupBy(F.col("batch_id").alias("_shared")).agg(F.count("*").alias("n"))
        shared = stage(shared.where((F.col("n") > 1) | F.col("_shared").isNull()).select("_shared"), "shared-names")
        texts = computed(batches, lines, messages).select(
            *batches.columns,
            F.coalesce(F.flatten(F.transform("_said", sentences)), F.array().cast("array<string>")).alias("_sentences"),
            F.transform(F.slice("_said", 1, max_facts), lambda m: F.regexp_extract(m, _FIRST_SENTENCE, 0)).alias("_facts"),
        )
        if shared.isEmpty():
            found = _salient_each(texts, max_chars, max_topics)
        else:
            same = F.col("batch_id").eqNullSafe(F.col("_shared"))
            found = _salient_each(texts.join(shared, same, "left_anti"), max_chars, max_topics).unionByName(
                _salient_together(texts.join(shared, same, "left_semi"), max_chars, max_topics))
        reply = F.struct(
            F.array_join(F.transform("_kept", lambda i: F.get("_sentences", i)), " ").alias("summary"),
            F.col("_topics").alias("topics"),
            F.col("_facts").alias("key_facts"),
            F.lit("neutral").alias("sentiment"),
            F.lit(0.5).alias("importance"),
        )
        return computed(found, F.to_json(reply), lambda v: [v.alias("raw")]).select(*batches.columns, "raw")

    return summarize


def _starts(sorted_items, key) -> Column:
    """Where each run of equal keys begins in a sorted array."""
    return F.array_compact(F.transform(sorted_items, lambda x, i: F.when((i == 0) | (key(F.get(sorted_items, i - 1)) != key(x)), i)))


def _salient_each(texts: DataFrame, max_chars: int, max_topics: int) -> DataFrame:
    """Adds ``_kept`` (numbers of the sentences kept, in order) and ``_topics`` from the ``_sentences`` of each row alone.

    Words and sentences are brought into runs by sorting inside the row, so the work grows with the text and not with its square.
    """
    def spoken(s, i):
        return F.transform(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), i.alias("s")))

    words = F.sort_array(F.flatten(F.transform("_sentences", spoken)))
    texts = computed(texts, words, lambda v: [v.alias("_w"), _starts(v, lambda x: x["w"]).alias("_at")])

    def counted(p, j):
        word = F.get("_w", p)
        n = F.coalesce(F.get("_at", j + 1), F.size("_w")) - p
        return F.struct(word["w"].alias("word"), n.alias("n"), word["s"].alias("s"), F.length(F.bin(n)).alias("weight"))

    def named(v):
        long = F.filter(v, lambda c: F.length(c["word"]) >= _TOPIC)
        often = F.sort_array(F.transform(long, lambda c: F.struct((-c["n"]).alias("often"), c["word"].alias("word"))))
        # Every sentence is there with 0 as well, as one that adds no word may fill what room is left.
        own = F.transform("_sentences", lambda _, i: F.struct(i.alias("s"), F.lit(0).alias("weight")))
        by = F.sort_array(F.concat(own, F.transform(v, lambda c: F.struct(c["s"].alias("s"), c["weight"].alias("weight")))))
        return [F.slice(often, 1, max_topics).getField("word").alias("_topics"), by.alias("_by")]

    texts = computed(texts, F.transform("_at", counted), named).drop("_w", "_at")
    texts = computed(texts, F.col("_by"), lambda v: [_starts(v, lambda x: x["s"]).alias("_at")])

    def scored(p, j):
        run = F.slice("_by", p + 1, F.coalesce(F.get("_at", j + 1), F.size("_by")) - p)
        score = F.aggregate(run, F.lit(0), lambda total, x: total + x["weight"])
        return F.struct((-score).alias("least"), F.get("_by", p)["s"].alias("s"))

    none = F.struct(F.lit(0).alias("through"), F.array().cast("array<int>").alias("kept"))

    def filled(so_far, x):
        through = so_far["through"] + F.length(F.get("_sentences", x["s"])) + 1
        kept = F.when(through <= max_chars + 1, F.array_append(so_far["kept"], x["s"])).otherwise(so_far["kept"])
        return F.struct(through.alias("through"), kept.alias("kept"))

    best = F.sort_array(F.transform("_at", scored))
    return computed(texts, best, lambda v: [F.sort_array(F.aggregate(v, none, filled)["kept"]).alias("_kept")]).drop("_by", "_at")


def _salient_together(texts: DataFrame, max_chars: int, max_topics: int) -> DataFrame:
    """The same for texts that share their ``batch_id``: their words are counted over all of them. Without one nothing is kept."""
    texts = texts.repartition("batch_id")
    key = ["batch_id"]
    words = counted_words(word_rows(texts, key, 0, "_sentences"), key)
    long = is_word() & (F.length("word") >= _TOPIC)
    often = Window.partitionBy(*key).orderBy(F.desc(long), F.desc("n"), "word")
    words = words.withColumn("_topic", F.when(long, F.row_number().over(often)))
    named = F.collect_list(F.when(F.col("_topic") <= max_topics, F.struct("_topic", "word")))
    scored = words.groupBy(*key, "key").agg(F.sum(weight()).alias("score"), named.alias("_named"))
    through = F.sum(room()).over(Window.partitionBy(*key).orderBy(*best_first()).rowsBetween(Window.unboundedPreceding, 0))
    kept = F.when(F.col("_through") <= max_chars + 1, number_of(F.col("key")))
    found = scored.withColumn("_through", through).groupBy(*key).agg(
        F.sort_array(F.collect_list(kept)).alias("_kept"),
        F.sort_array(F.flatten(F.collect_list("_named"))).getField("word").alias("_topics"),
    )
    return texts.join(found, key, "left").withColumns({
        "_kept": F.coalesce("_kept", F.array().cast("array<int>")), "_topics": F.coalesce("_topics", F.array().cast("array<string>")),
    })


def model_summarizer(reply_to, rows_per_call: int = 64, tasks: int | None = None):
    """A summarizer from a function ``list[str] → list[str | None]``, called once per chunk of rows.

    A chunk whose call fails has no replies, which quarantines its texts and no others. ``tasks`` sets how many
    calls may run side by side; without it they follow the partitions of the texts.
    """

    def summarize(batches: DataFrame) -> DataFrame:
        schema = T.StructType([*batches.schema.fields, T.StructField("raw", T.StringType())])

        def task(frames):
            for batch in frames:
                texts = batch.column("text").to_pylist()
                replies = []
                for lo in range(0, len(texts), rows_per_call):
                    asked = texts[lo : lo + rows_per_call]
                    try:
                        given = list(reply_to(asked))
                    except Exception:  # the model's own errors, of any kind
                        given = []
                    replies += given if len(given) == len(asked) else [None] * len(asked)
                yield batch.append_column("raw", pa.array(replies, pa.string()))

        return (batches if tasks is None else batches.repartition(tasks)).mapInArrow(task, schema)

    return summarize


def hashing_embedder(dim: int = 512):
    """Hashed word counts at unit length."""

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"), lambda w: w != "")
        df = df.withColumn("_words", words)
        df = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(df)
        df = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(df)
        return df.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")

    return embed


def model_embedder(make_predict, batch_size: int = 64, max_chars: int | None = None):
    """An embedder from a factory of ``array of str → matrix``; the model loads once per worker.

    ``max_chars`` cuts the input for models with an input limit.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        source = F.coalesce(F.col(text), F.lit(""))
        if max_chars is not None:
            source = F.substring(source, 1, max_chars)
        return df.withColumn(out, predict(source)).withColumn(out, l2_normalize(out).cast("array<float>"))

    return embed


def remembering_embedder(embedder, path: str, model: str):
    """An embedder that asks ``embedder`` for distinct texts it has not met under this ``model`` name, and no others.

    Vectors are kept at ``path`` (Parquet: key, vector), named by the hash of model and text, so any number of tables and runs may share them.
    The call is made when the embedder is applied. NULL texts count as empty. Vectors written twice, by a repeated
    run, are equal; one is taken.
    """

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        spark = df.sparkSession
        key, said = unused(df, "_key", "_text")
        named = df.withColumn(key, F.sha2(F.concat(F.lit(f"{model}\x1f"), F.coalesce(F.col(text), F.lit(""))), 256))
        texts = named.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias(said)).dropDuplicates(["key"])
        kept = _vectors(spark, path)
        if kept is not None:
            texts = texts.join(kept, "key", "left_anti")
        made = embedder(texts, said, "vector").select("key", "vector")
        made.write.mode("append").parquet(path)
        vectors = _vectors(spark, path).withColumnsRenamed({"key": key, "vector": out})
        return named.drop(out).join(vectors, key, "left").drop(key)

    return embed


def _vectors(spark, path: str) -> DataFrame | None:
    try:
        found = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.groupBy("key").agg(F.any_value("vector").alias("vector"))
