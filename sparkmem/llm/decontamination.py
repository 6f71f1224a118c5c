"""Benchmark decontamination by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import unused
from ..sources.staging import stage
from .common import read_table, whole

#: What lies between words: ASCII other than digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shingle table of at most so many rows (some 100 bytes each) is broadcast; a larger one is joined by Spark's own choice.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), NO_WORD), "")


def _shingles(array: str, size: int) -> str:
    """SQL: every run of ``size`` words of an array that has as many: place, hash, first and last word."""
    parts = ", ".join(f"get({array}, i + {j})" for j in range(size))
    return (
        f"transform(sequence(0, size({array}) - {size}), i -> struct(i AS _pos, xxhash64({parts}) AS _shingle, "
        f"get({array}, i) AS _first, get({array}, i + {size - 1}) AS _last))"
    )


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the items: (_window, _w its words, _length, _items sorted ids).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), words(whole()).alias("_w")).where(F.size("_w") > 0)
    spans = items.select("_item", F.explode(F.expr(
        f"CASE WHEN size(_w) <= {window} THEN array(_w) ELSE transform(sequence(1, size(_w) - {window} + 1), i -> slice(_w, i, {window})) END"
    )).alias("_w"))
    return spans.groupBy(F.concat_ws(" ", "_w").alias("_window")).agg(
        F.first("_w").alias("_w"), F.first(F.size("_w")).alias("_length"), F.array_sort(F.collect_set("_item")).alias("_items")
    )


def window_occurrences(docs: DataFrame, windows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Where windows occur in documents (_row, _window, _start, _length), and (_row, _n_words) of each row.

    ``docs``: (_row, text). One pass over the texts joins their shingles with those of the
    windows and writes down the few that match, with one row per text for its number of words; all later steps
    work on that table:

    - shingles are ordered by rarity, their number of places in the documents;
    - exact containment needs every shingle of a window, so the prefix that must be met
      is one token: the rarest. Only its places become candidates;
    - a candidate's window must begin and end inside the document;
    - it is verified shingle by shingle at the exact places, by the words themselves: the first and
      last words of its shingles are all words of the window.

    A window shorter than a shingle is one shingle of its own length.
    """
    sizes = sorted(r[0] for r in windows.select(F.least("_length", F.lit(size))).distinct().collect())
    each = None
    for n in sizes:
        of_size = windows.where(F.least("_length", F.lit(size)) == n).select("_window", "_length", F.inline(F.expr(_shingles("_w", n))))
        each = of_size if each is None else each.unionByName(of_size)
    # The row that stands for a text itself; its key meets the marker in the table of known shingles.
    marker = F.array(F.struct(
        F.lit(-1).alias("_pos"), F.lit(0).cast("long").alias("_shingle"), F.lit(None).cast("string").alias("_first"), F.lit(None).cast("string").alias("_last"),
    ))
    known = docs.sparkSession.range(1).select(F.col("id").alias("_shingle"))
    if each is not None:
        each = stage(each.withColumnRenamed("_pos", "_offset"), "shingles")
        known = known.unionByName(each.select("_shingle")).distinct()
    texts = docs.select("_row", words(whole()).alias("_w")).withColumn("_n_words", F.size("_w").cast("long"))
    runs = [F.when(F.size("_w") >= n, F.expr(_shingles("_w", n))).otherwise(F.array()) for n in sizes]
    places = texts.select("_row", "_n_words", F.inline(F.concat(marker, *runs)))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    found = stage(places.join(known, "_shingle"), "matches")
    counts = found.where("_pos = -1").select("_row", "_n_words")
    found = found.where("_pos >= 0").distinct()
    if each is None:
        return found.select("_row", F.lit("").alias("_window"), F.col("_pos").alias("_start"), F.lit(0).alias("_length")), counts

    rarity = found.groupBy("_shingle").agg(F.count("*").alias("_places"))
    # A window one of whose shingles never occurs cannot occur: the join drops its row, the counts differ.
    whole_window = Window.partitionBy("_window")
    ranked = each.withColumn("_needed", F.count("*").over(whole_window)).join(rarity, "_shingle").withColumns({
        "_rank": F.row_number().over(whole_window.orderBy("_places", "_offset")), "_there": F.count("*").over(whole_window),
    })
    possible = stage(ranked.where(F.col("_there") == F.col("_needed")), "prefixes")
    prefix = possible.where("_rank = 1").select("_window", "_length", "_offset", "_shingle")
    candidates = found.join(prefix, "_shingle").select(
        "_row", "_window", (F.col("_pos") - F.col("_offset")).alias("_start"), "_length", "_n_words"
    ).where((F.col("_start") >= 0) & (F.col("_start") + F.col("_length") <= F.col("_n_words"))).distinct()
    expected = candidates.join(possible.select("_window", "_offset", "_shingle", "_first", "_last", "_needed"), "_window").select(
        "_row", "_window", "_start", "_needed", "_length", (F.col("_start") + F.col("_offset")).alias("_pos"), "_shingle", "_first", "_last"
    )
    verified = (
        expected.join(found.drop("_n_words"), ["_row", "_pos", "_shingle", "_first", "_last"])
        .groupBy("_row", "_window", "_start", "_needed", "_length").agg(F.count("*").alias("_met"))
        .where(F.col("_met") == F.col("_needed"))
    )
    return verified.select("_row", "_window", "_start", "_length"), counts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, size: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window), items, contaminated.

    ``items`` are the sorted ids, as strings, of the items with occurring windows. NULL and empty texts have no
    words; rows are told apart by doc_id (which may be NULL or repeat) and text, so repeated
    rows get equal results; items without words are ignored; an empty benchmark hits nothing. Only
    doc_id, text, item_id and text are read.
    """
    keyed = docs.select(F.struct(F.col("doc_id"), F.xxhash64(whole()).alias("h")).alias("_row"), "text")
    windows = stage(item_windows(benchmark, window), "item-windows")
    spans, counts = window_occurrences(keyed, windows, size)
    spans = stage(spans, "occurrences")
    hit = (
        spans.select("_row", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_length") - 1)).alias("_pos"))
        .distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    )
    items = (
        spans.select("_row", "_window").distinct().join(windows.select("_window", F.explode("_items").alias("_item")), "_window")
        .groupBy("_row").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    )
    return counts.join(hit.join(items, "_row"), "_row", "left").select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.col("_row.h").alias("text_hash"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, unchanged, whatever their other columns are called."""
    name, text = unused(docs, "_id", "_h")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(name), F.col("text_hash").alias(text)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64(whole()) == F.col(text)), "left_anti")


def op6_prefix_filtered_join(spark, sf_dir):
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_DUCK_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_DUCK_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, CASE WHEN len(w) <= 10 THEN w ELSE w[i:i + 9] END AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
d AS (SELECT doc_id, coalesce({_DUCK_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
occ AS (SELECT doc_id, n, i, item FROM places JOIN wins USING (win)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY 1
),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
