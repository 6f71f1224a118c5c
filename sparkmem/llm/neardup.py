"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import unused
from ..sources.staging import stage
from .common import read_table, whole
from .words import mix, pieces, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Document frequencies are kept for so many word buckets (2 MB a task), whatever the vocabulary.
BUCKETS = 1 << 18
_POOL = 1 << 12
#: Room for rounding in the bounds of ``prefix_pairs``.
_SLACK = 1e-4
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_drawn: dict[int, tuple[np.ndarray, ...]] = {}


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every word bucket over all rows of ``docs`` (text): log((N + 1) / (df + 1)) + 1.

    Frequencies are those of words: a shingle weighs its count times the mean idf of its words. A shingle's own
    frequency would fall with the size of the group of copies that shares it, and push large groups
    under the bar. Rare words that share a bucket are still rare; at most ``BUCKETS`` counts reach the driver.
    """
    def count(batches):
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, at in pieces(batch.column(0)):
                hashes, text, _, _ = word_hashes(data, at)
                once = np.unique(text * BUCKETS + _bucket(hashes))
                seen += np.bincount(once & (BUCKETS - 1), minlength=BUCKETS)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(there, -1)), pa.array(np.append(seen[there], rows))], ["bucket", "n"]
        )

    got = docs.select(whole()).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (got.column(c).to_numpy() for c in ("bucket", "n"))
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return (np.log((n[bucket < 0].sum() + 1) / (df + 1)) + 1).astype(np.float32)


def weighted_shingles(data: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs in text order with their TF-IDF weights.

    A shingle is five words in a row; a text of fewer words, but not none, is one shingle.
    """
    hashes, text, _, _ = word_hashes(data, at)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    value = idf[_bucket(hashes)].astype(np.float64)
    n = len(hashes)
    begin = np.searchsorted(text, text)  # a word's text begins there
    end = np.searchsorted(text, text, "right")
    first = np.flatnonzero((np.arange(n) + SHINGLE <= end) | (np.arange(n) == begin))
    last = np.minimum(first + SHINGLE, end[first])
    mixed = np.zeros(len(first), np.uint64)
    for j in range(SHINGLE):
        spot = np.minimum(first + j, n - 1)
        mixed += np.where(first + j < last, hashes[spot] * _TURNS[j], np.uint64(0))
    shingle = mix(mixed)
    sums = np.append(0.0, np.cumsum(value))
    mean = (sums[last] - sums[first]) / (last - first)
    owner = text[first]
    _, where, times = np.unique(mix(shingle + owner.astype(np.uint64) * _TURNS[0]), return_index=True, return_counts=True)
    order = np.argsort(where)
    where, times = where[order], times[order]
    return owner[where], shingle[where], (times * mean[where]).astype(np.float32)


def _draws(samples: int) -> tuple[np.ndarray, ...]:
    """Pools of the method's random numbers: r and c from Gamma(2, 1), beta from [0, 1).

    A shingle's numbers are three rows of the pools, picked by separate bits of its hash.
    """
    if samples not in _drawn:
        rng = np.random.default_rng(20)
        r, c = (rng.gamma(2.0, 1.0, (_POOL, samples)).astype(np.float32) for _ in range(2))
        _drawn[samples] = np.maximum(r, 1e-4), np.log(np.maximum(c, 1e-12)), rng.random((_POOL, samples), np.float32)
    return _drawn[samples]


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, samples: int) -> np.ndarray:
    """Consistent weighted samples (texts × samples) as the bits of the smallest ln a.

    For weight w: t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r. The smallest ln a names
    its shingle and t, as it depends on nothing else; two texts agree in a sample with the chance of
    their weighted Jaccard similarity.
    """
    r, c, beta = _draws(samples)
    least = np.full((texts, samples), np.inf, np.float32)
    logs = np.log(weight)
    pick = [((shingle >> np.uint64(k)) & np.uint64(_POOL - 1)).astype(np.int64) for k in (0, 12, 24)]
    for a in range(0, len(owner), 4096):
        part = slice(a, a + 4096)
        rr, bb = r[pick[0][part]], beta[pick[2][part]]
        t = logs[part, None] / rr
        t += bb
        np.floor(t, out=t)
        t -= bb
        t += 1
        t *= rr
        value = c[pick[1][part]]
        value -= t
        own = owner[part]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lowest = np.minimum.reduceat(value, starts, axis=0)
        least[own[starts]] = np.minimum(least[own[starts]], lowest)
    return least.view(np.uint32)


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, _node, _bands): a text's identity (a 64-bit hash) and its band keys; none for a text without words."""
    def sign(batches):
        for batch in batches:
            keys, sizes = [], []
            for first, last, data, at in pieces(batch.column(2)):
                owner, shingle, weight = weighted_shingles(data, at, idf)
                bits = signatures(owner, shingle, weight, last - first, BANDS * ROWS).astype(np.uint64)
                bits = bits.reshape(last - first, BANDS, ROWS)
                band = mix((bits * _TURNS[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _TURNS[4])
                some = np.bincount(owner, minlength=last - first) > 0
                keys.append(band[some].ravel())
                sizes.append(some * BANDS)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], ["doc_id", "_node", "_bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", node().alias("_node"), whole()).mapInArrow(sign, f"doc_id {kind}, _node long, _bands array<bigint>")


def node():
    return F.xxhash64(whole())


def similarities(pairs: DataFrame, bodies: DataFrame, idf: np.ndarray) -> DataFrame:
    """Weighted Jaccard similarity of (_a, _b), pairs of nodes: sum of the smaller weights over sum of the larger."""
    def compare(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows)
            at, rows = 0, max(1, int(4e6 * batch.num_rows / max(1, batch.nbytes)))
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                found[at:at + part.num_rows] = _jaccard(part.column(2), part.column(3), idf)
                at += rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["_a", "_b", "_similarity"])

    both = pairs.join(bodies.select(F.col("_node").alias("_a"), F.col("_text").alias("_ta")), "_a").join(
        bodies.select(F.col("_node").alias("_b"), F.col("_text").alias("_tb")), "_b"
    )
    return both.select("_a", "_b", "_ta", "_tb").mapInArrow(compare, "_a long, _b long, _similarity double")


def _jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    pair, shingle, weight, side = [], [], [], []
    for s, column in enumerate((left, right)):
        for first, _, data, at in pieces(column):
            o, h, w = weighted_shingles(data, at, idf)
            pair.append(o + first)
            shingle.append(h)
            weight.append(w.astype(np.float64))
            side.append(np.full(len(o), s))
    pair, shingle, weight, side = map(np.concatenate, (pair, shingle, weight, side))
    _, spot, inverse = np.unique(mix(shingle + pair.astype(np.uint64) * _TURNS[1]), return_index=True, return_inverse=True)
    a, b = (np.bincount(inverse[side == s], weight[side == s], len(spot)) for s in (0, 1))
    n = len(left)
    low, high = (np.bincount(pair[spot], f(a, b), n) for f in (np.minimum, np.maximum))
    return low / np.maximum(high, 1e-300)


def components(edges: DataFrame) -> DataFrame:
    """(_node, _component: the smallest node it is connected with) of an edge list (_a, _b), by alternating stars.

    Large star: every node links its larger neighbours to its smallest one; small star: a node links its smaller
    neighbours and itself to the smallest. Both are a minimum by key and a join, so a hub's edges stay
    spread out; each round is written down, and the rounds grow with the logarithm of the longest chain.
    """
    def fingerprint(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first())

    edges = stage(edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "edges")
    seen = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        lowest = both.groupBy("_a").agg(F.least(F.min("_b"), F.first("_a")).alias("_m"))
        large = both.join(lowest, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a <> _b").distinct()
        lowest = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(lowest, "_a").select(F.explode(F.array("_a", "_b")).alias("_a"), F.col("_m").alias("_b")).where("_a <> _b").distinct()
        edges = stage(small, "edges")
        now = fingerprint(edges)
        if now == seen:
            return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_component"))
        seen = now


def _between_components(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of (_band, _node, …) with their ``_component``, of the bands that hold more than one."""
    placed = rows.join(linked, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))
    mixed = placed.groupBy("_band").agg(F.min("_component").alias("_low"), F.max("_component").alias("_high"))
    return placed.join(mixed.where("_low <> _high").select("_band"), "_band")


def prefix_pairs(bodies: DataFrame, nodes: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Pairs (_a > _b) of ``nodes`` (_node, _component) in different components, without any that are not similar by
    an exact bound.

    Shingles are ordered by rarity among the nodes. Similar texts share a weight of ``similarity`` times the heavier
    one's, so the first shingle they share begins within the first 1 - similarity of each text's weight, and what
    follows it in both is heavy enough. Edits come first in that order: a copy with many of its own has no
    shared shingle there and meets nobody.
    """
    def shingled(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, data, at in pieces(batch.column(1)):
                owner, shingle, weight = weighted_shingles(data, at, idf)
                weight = weight.astype(np.float64)
                total = np.bincount(owner, weight, last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + owner]), pa.array(shingle.view(np.int64)), pa.array(weight), pa.array(total[owner])],
                    ["_node", "_shingle", "_weight", "_total"],
                )

    texts = bodies.join(nodes.select("_node"), "_node").dropDuplicates(["_node"])
    rows = stage(texts.mapInArrow(shingled, "_node long, _shingle long, _weight double, _total double"), "shingles")
    shared = rows.groupBy("_shingle").agg(F.count("*").alias("_df")).where("_df > 1")
    text = Window.partitionBy("_node")
    earlier = text.orderBy("_df", "_shingle").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("_total") - F.sum("_weight").over(text)  # weight of the shingles no other node has: they come first
    prefix = (
        rows.join(shared, "_shingle")
        .withColumn("_before", alone + F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)))
        .where(F.col("_before") <= (1 - similarity + _SLACK) * F.col("_total"))
        .join(nodes, "_node")
        .select("_shingle", "_node", "_component", "_total", (F.col("_total") - F.col("_before")).alias("_after"))
    )
    prefix = stage(prefix, "prefixes")
    mixed = prefix.groupBy("_shingle").agg(F.min("_component").alias("_low"), F.max("_component").alias("_high"))
    prefix = prefix.join(mixed.where("_low <> _high").select("_shingle"), "_shingle")
    other = prefix.withColumnsRenamed({c: f"{c}_b" for c in ("_node", "_component", "_total", "_after")})
    least = (similarity / (1 + similarity) - _SLACK) * (F.col("_total") + F.col("_total_b"))
    return prefix.join(other, "_shingle").where(
        (F.col("_node") > F.col("_node_b")) & (F.col("_component") != F.col("_component_b"))
        & (F.least("_after", "_after_b") >= least)
    ).select(F.col("_node").alias("_a"), F.col("_node_b").alias("_b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), n_links, class_rows, text_hash, class_key.

    Equal texts are one node. Nodes that share a band key are candidates; links are candidates whose weighted Jaccard
    similarity is at least ``similarity``; classes are connected nodes. ``n_links`` counts a text's
    verified links; two texts that others have already put into one class are not compared.

    No bucket is expanded into all its pairs. Every member is compared with the bucket's smallest node, then with that
    node's nearest member, which in a group of edited copies lies close to what they were copied from. What is linked
    becomes one component. Members of buckets that still hold several components are compared where ``prefix_pairs``
    cannot rule out a link.

    NULL and empty texts, and texts without words, are alike only if equal. A NULL doc_id takes its class from its
    text; class_id is NULL if all ids of a class are, and different classes share it if ids are repeated: ``class_key``, the
    smallest text_hash of a class, tells them apart. Only doc_id and text are read.
    """
    idf = inverse_frequencies(docs)
    table = stage(signed(docs, idf), "signatures")
    nodes = table.groupBy("_node").agg(F.min("doc_id").alias("_doc"), F.first("_bands").alias("_bands"))
    rows = stage(nodes.select("_node", "_doc", F.explode("_bands").alias("_band")), "bands")
    buckets = rows.groupBy("_band").agg(F.count("*").alias("_size"), F.min("_node").alias("_lead")).where("_size > 1").drop("_size")
    buckets = stage(rows.select("_node", "_band").join(buckets, "_band"), "buckets")
    # The texts of the nodes that share a band with another, one row each.
    needed = buckets.select("_node").distinct().join(rows.select("_node", "_doc").distinct(), "_node")
    body = docs.select(node().alias("_node"), F.col("doc_id").alias("_doc"), whole().alias("_text"))
    bodies = stage(body.join(needed, (body["_node"] == needed["_node"]) & body["_doc"].eqNullSafe(needed["_doc"]), "left_semi").select("_node", "_text"), "bodies")

    pairs = buckets.where("_node <> _lead").select(F.col("_node").alias("_a"), F.col("_lead").alias("_b")).distinct()
    compared = stage(similarities(pairs, bodies, idf).groupBy("_a", "_b").agg(F.max("_similarity").alias("_similarity")), "compared")
    links = compared.where(F.col("_similarity") >= similarity)
    linked = components(links.select("_a", "_b"))

    members = _between_components(buckets.where("_node <> _lead"), linked)
    far = compared.select(F.col("_a").alias("_node"), F.col("_b").alias("_lead"), F.col("_similarity").alias("_near"))
    members = stage(members.join(far, ["_node", "_lead"]).select("_band", "_node", "_component", "_near"), "members")
    nearest = F.struct((-F.col("_near")).alias("far"), "_node")
    pivots = members.groupBy("_band").agg(
        F.min_by("_node", nearest).alias("_pivot"), F.min_by("_component", nearest).alias("_pivot_component")
    )
    pairs = members.join(pivots, "_band").where("_component <> _pivot_component").select(
        F.greatest("_node", "_pivot").alias("_a"), F.least("_node", "_pivot").alias("_b")
    ).distinct()
    second = stage(similarities(pairs, bodies, idf).where(F.col("_similarity") >= similarity).select("_a", "_b").distinct(), "compared-pivots")
    known = linked.select(F.col("_node").alias("_a"), F.col("_component").alias("_b"))
    linked = components(second.unionByName(known))

    open_nodes = _between_components(members.select("_band", "_node"), linked).select("_node", "_component").distinct()
    pairs = prefix_pairs(bodies, stage(open_nodes, "open"), idf, similarity)
    third = stage(similarities(pairs, bodies, idf).where(F.col("_similarity") >= similarity).select("_a", "_b").distinct(), "compared-rest")
    known = linked.select(F.col("_node").alias("_a"), F.col("_component").alias("_b"))
    linked = components(third.unionByName(known))
    links = links.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).unionByName(second).unionByName(third).distinct()

    degree = links.select(F.explode(F.array("_a", "_b")).alias("_node")).groupBy("_node").agg(F.count("*").alias("n_links"))
    placed = table.select("doc_id", "_node").join(linked, "_node", "left").join(degree, "_node", "left")
    placed = placed.withColumns({"_component": F.coalesce("_component", "_node"), "n_links": F.coalesce("n_links", F.lit(0))})
    classes = placed.groupBy("_component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return placed.join(classes, "_component").select("doc_id", "class_id", "n_links", "class_rows", F.col("_node").alias("text_hash"), F.col("_component").alias("class_key"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their class, one row a class, unchanged."""
    found = stage(near_duplicates(docs, similarity), "classes")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Of texts of one class under one id, the smallest hash stays.
    stays = kept.groupBy("class_key", "doc_id").agg(F.min("text_hash").alias("_hash"), F.count("*").alias("_n"))
    text, name, other = unused(docs, "_hash", "_id", "_h")
    left = docs.withColumn(text, node())
    kept_rows = left.join(
        stays.select(F.col("doc_id").alias(name), F.col("_hash").alias(other)),
        F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(text) == F.col(other)), "left_semi",
    )
    if stays.where("_n > 1").limit(1).count():
        kept_rows = kept_rows.dropDuplicates(["doc_id", text])
    return kept_rows.drop(text)


def op10_weighted_minhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_rows")
