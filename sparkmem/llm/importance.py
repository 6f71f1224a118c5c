"""Importance resampling towards a target: hashed n-gram counts of both corpora and a Gumbel draw.

Buckets are CRC-32 values of the features' bytes. CRC-32 is linear over XOR but for a constant of the length, so
a table holds what each byte adds at each distance from the end, and one ``bitwise_xor.reduceat`` folds all
features of a batch. Spans longer than the table are cut into blocks from their ends; the blocks' remainders are
folded by the same rule, with tables for steps of a whole block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import number_rows
from ..sources.staging import stage
from .common import read_table, whole
from .words import LOWER, pieces, word_hashes

#: Distances from the end that a table knows; longer spans fold in blocks of so many.
WIDTH = 64
# The reversed polynomial of CRC-32 as zlib, gzip and Spark's crc32 have it: a fixed value.
_POLYNOMIAL = 0xEDB88320
_tables: dict = {}


def _shifted(value: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Remainders after as many zero bytes as ``one`` stands for (one: 4 × 256, by place and value of a remainder's byte)."""
    out = one[0][value & 255]
    for place in (1, 2, 3):
        out = out ^ one[place][(value >> np.uint32(8 * place)) & 255]
    return out


def _byte_table() -> np.ndarray:
    """WIDTH × 256: what a byte adds to the remainder, by its distance from the end."""
    if "bytes" not in _tables:
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = np.where(first & 1, (first >> 1) ^ np.uint32(_POLYNOMIAL), first >> 1).astype(np.uint32)
        rows = [first]
        for _ in range(WIDTH - 1):
            rows.append(first[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
        _tables["bytes"] = np.array(rows)
    return _tables["bytes"]


def _block_table(level: int) -> np.ndarray:
    """WIDTH × 4 × 256: what a byte of a remainder adds, by its block's distance from the end in blocks of WIDTH ** level bytes."""
    if level not in _tables:
        plain = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
        if level == 1:
            first, one = _byte_table()[0], plain
            for _ in range(WIDTH):
                one = first[one & 255] ^ (one >> np.uint32(8))
        else:
            below = _block_table(level - 1)
            one = _shifted(below[WIDTH - 1], below[1])
        rows = [plain]
        for _ in range(WIDTH - 1):
            rows.append(_shifted(rows[-1], one))
        _tables[level] = np.array(rows)
    return _tables[level]


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC of so many zero bytes: what the start and end values of CRC-32 add."""
    if "lengths" not in _tables:
        _tables["lengths"] = np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], np.uint32)
    known = _tables["lengths"]
    out = known[np.minimum(lengths, WIDTH)]
    far = np.flatnonzero(lengths > WIDTH)
    if len(far):
        sizes, which = np.unique(lengths[far], return_inverse=True)
        out[far] = np.array([zlib.crc32(bytes(int(n))) for n in sizes], np.uint32)[which]
    return out


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of so many units, cut into blocks of WIDTH from their ends: distance from the end of each unit, the unit at
    which each block begins, and the blocks of each span."""
    ends = np.cumsum(counts)
    distance = np.repeat(ends, counts) - 1 - np.arange(ends[-1])
    per = -(-counts // WIDTH)
    last = np.repeat(np.cumsum(per), per) - 1 - np.arange(per.sum())  # blocks after this one in its span
    starts = np.maximum(np.repeat(ends, per) - (last + 1) * WIDTH, np.repeat(ends - counts, per))
    return distance % WIDTH, starts, per


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for every span (uint32 data of bytes; spans may lie in any order and overlap)."""
    lengths = ends - starts
    out = _length_constants(lengths)
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    counts = lengths[full]
    at = np.arange(counts.sum()) + np.repeat(starts[full] - np.cumsum(counts) + counts, counts)
    distance, firsts, counts = _blocks(counts)
    folded = np.bitwise_xor.reduceat(_byte_table()[distance, data[at]], firsts)
    level = 1
    while (counts > 1).any():
        table = _block_table(level)
        distance, firsts, per = _blocks(counts)
        added = table[distance, 0, folded & 255]
        for place in (1, 2, 3):
            added ^= table[distance, place, (folded >> np.uint32(8 * place)) & 255]
        folded = np.bitwise_xor.reduceat(added, firsts)
        counts, level = per, level + 1
    out[full] ^= folded
    return out


def _features(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to ``longest`` consecutive words of texts that lie at ``at``; texts of a run length in order."""
    _, text, starts, ends = word_hashes(data, at)
    low = LOWER[data]
    if longest > 1:  # the words again, one space after each, so that a run of words is a span
        sizes = ends - starts
        firsts = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int((sizes + 1).sum()), 32, low.dtype)
        move = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(firsts, sizes) + move] = low[np.repeat(starts, sizes) + move]
        low, starts, ends = joined, firsts, firsts + sizes
    texts, values = [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(starts))
        last = last[text[last] == text[last - n + 1]]
        texts.append(text[last])
        values.append(crc32_spans(low, starts[last - n + 1], ends[last]) % np.uint32(buckets))
    return np.concatenate(texts), np.concatenate(values)


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10000) -> np.ndarray:
    """Features of all texts in each bucket. A task hands on one count a bucket it has met, so the shuffle and the driver
    see at most ``buckets`` rows a task and in all, whatever the corpus."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                total += np.bincount(_features(data, at, longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    rows = docs.select(whole()).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the scaled log-ratio of its smoothed shares in target and source, floored."""
    s, t, buckets = source.astype(np.float64), target.astype(np.float64), len(source)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def gumbel(key: Column, seed: int = 2024, scale: int = 1000) -> Column:
    """Scaled Gumbel noise that depends on the seed and the key alone (a NULL key counts as an empty one), floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``n_features`` and ``weight`` (longs): the sum of the gains of all features of the whole text.

    The corpus that is drawn from is ``docs`` itself, all of it. ``keep`` names the columns carried along (default: all).
    NULL and empty texts have no features and weight 0, so have all texts if both corpora are empty. A very long text is
    one row and one pass over its bytes. Columns of the added names are replaced.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    added = ("n_features", "weight")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in added]])

    def weigh(batches):
        for batch in batches:
            features, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, last, data, at in pieces(batch.column(batch.num_columns - 1)):
                texts, values = _features(data, at, longest, buckets)
                order = np.argsort(texts, kind="stable") if longest > 1 else slice(None)
                run = np.concatenate([[0], np.cumsum(gain[values[order]])])
                n = np.bincount(texts, minlength=last - first)
                ends = np.cumsum(n)
                features[first:last], weight[first:last] = n, run[ends] - run[ends - n]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(features), pa.array(weight)], schema.names)

    # By place and not by name, as a kept column may have any name; the text to read comes last.
    placed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    return docs.select(*placed, whole().alias("text")).mapInArrow(weigh, schema)


def importance_resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, percent: int = 10, min_words: int = 20,
    seed: int = 2024, key: str = "doc_id", keep: list[str] | None = None,
) -> DataFrame:
    """``importance_weights`` with ``score`` (weight plus Gumbel noise) and ``rank``: 1, 2, 3 … for the
    floor(percent × N / 100) rows with the highest scores among the N of at least ``min_words`` features, else NULL.

    Equal scores go by smaller ``key``, NULL keys last; equal keys in any order, once. Keyed noise makes the draw one without
    replacement in proportion to exp(weight / scale), and a second run draws the same rows. Ranks come from a range exchange
    and counts per task, so no task orders all rows. With ``longest`` over 1, features and not words count
    against ``min_words``. An empty table stays empty; columns of the added names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "rank")]
    noise = F.col("weight") + gumbel(F.col(f"`{key}`"), seed)
    scored = stage(importance_weights(docs, target, longest, buckets, kept).withColumn("score", noise), "importance")
    fits = F.col("n_features") >= min_words
    drawn = scored.where(fits).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(f"`{key}`")]
    ranked = number_rows(scored.where(fits), [], order).drop("group_rows").withColumnRenamed("position", "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark, sf_dir):
    """Documents drawn for likeness to the benchmark texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = importance_resampled(docs, read_table(spark, sf_dir, "benchmark").select("text"), keep=["doc_id"])
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows in DuckDB, CRC-32 byte by byte over the distinct words.
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counted AS (SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
hexes AS (SELECT w, lower(hex(encode(w))) AS h FROM (SELECT DISTINCT w FROM counted)),
hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], [16 * (instr('0123456789abcdef', h[2 * i + 1]) - 1) + instr('0123456789abcdef', h[2 * i + 2]) - 1
      FOR i IN range(length(h) // 2)]),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM hexes, crc_table),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g
  FROM sums, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums)),
weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight
  FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
      / 4294967296))) AS BIGINT) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
