"""Exact and approximate nearest-memory search for many prompts at once.

Vectors meet in blocks: a task multiplies a block of prompts with a block of
memories and emits only the best k per prompt, so pairs are never rows. Prompts
and memories of one user are cut into blocks of bounded size, so one user may own
most of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage
from .filters import where_metadata
from .ordering import top_rows

# Rows of a block at most, and numbers in its vectors: a block of prompts is sent to each block of memories and the other way
# round, so small blocks multiply what is shuffled.
QUERY_BLOCK, QUERY_VALUES = 8192, 1 << 20
MEMORY_BLOCK, MEMORY_VALUES = 32768, 1 << 22
SAMPLE, SAMPLE_PROMPTS = 8192, 256  # vectors and prompts the approximate search learns from, at most
SMALL_QUERIES = 1024  # prompts that may travel inside a task closure
SMALL_BYTES = 64 << 20
_SLICE, _SLICE_VALUES = 256, 1 << 21  # prompts, and cosines, that are looked at together
_DIGITS = 10  # cosines are rounded so that ties do not depend on the order of summation


def knn(
    queries: DataFrame,
    memories: DataFrame,
    k: int,
    where: dict | None = None,
    min_cosine: float | None = None,
    carry: tuple[str, ...] = (),
    few_prompts: bool = False,
) -> DataFrame:
    """Exact top-k memories of the same user per prompt, by cosine, then id.

    ``queries``: query_id, user_id, q_embedding. ``min_cosine`` is applied inside the
    blocks; it commutes with top-k. ``carry`` names memory columns to keep: they stay out of the search and are
    joined to the hits. A prompt without a user finds nothing; vectors of another
    length than the prompt's do not match. ``few_prompts``: the caller knows that the prompts fit into a task closure (at most
    SMALL_QUERIES rows and SMALL_BYTES, else ValueError); the memories are then read where they lie, with the same result.
    """
    queries = _vectors(queries, "q_embedding").where(F.col("user_id").isNotNull()).select("user_id", "_dim", "query_id", "q_embedding")
    stored = where_metadata(memories, where or {})
    vectors = _vectors(stored, "embedding").select("user_id", "_dim", "id", "embedding")
    if few_prompts:
        parts = _scan(_fetch_small(queries), queries, vectors, k, min_cosine)
    else:
        parts = _grid(queries, vectors, ["user_id", "_dim"], k, min_cosine)
    return _with_columns(_ranked(parts, k), stored, carry)


def knn_min_importance(queries: DataFrame, memories: DataFrame, k: int, min_importance: float = 0.3) -> DataFrame:
    """Over-fetch 2k, drop unimportant memories, keep k: fewer than k may remain."""
    wide = knn(queries, memories, 2 * k, carry=("importance",))
    return top_rows(
        wide.where(F.col("importance") >= min_importance).drop("rank"),
        ["query_id"],
        [F.desc("cosine"), "id"],
        k,
    )


def knn_approx(
    queries: DataFrame,
    memories: DataFrame,
    k: int,
    lists: int = 64,
    probes: int | None = None,
    target: float = 0.95,
    seed: int = 7,
    where: dict | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Approximate top-k: memories are filed under the nearest of ``lists`` centroids and each prompt looks into the nearest lists.

    Centroids are learnt from a bounded sample (``SAMPLE`` vectors). How many lists to look into is measured there too: as few as hold
    ``target`` of the true neighbours of sampled prompts in the sample, which are farther apart than in the whole
    table. So clustered vectors need few lists; where more than half of them would be needed, filing spares nothing and the search
    is exact. ``probes`` sets the number instead; all of them give the exact result. A list that outgrows a block is searched
    block by block like any other group. Prompts whose lists hold fewer than k memories are searched exactly, so k are found wherever
    k exist.
    """
    queries = _vectors(queries, "q_embedding").select("user_id", "_dim", "query_id", "q_embedding")
    stored = where_metadata(memories, where or {})
    vectors = _vectors(stored, "embedding").select("user_id", "_dim", "id", "embedding")
    centroids, needed = _trained(vectors, queries, k, lists, target, seed)
    probes = needed if probes is None else probes
    if 2 * probes > lists and probes < lists:
        return _with_columns(_ranked(_grid(queries, vectors, ["user_id", "_dim"], k, None), k), stored, carry)
    filed = _file_under(vectors, "embedding", centroids, 1)
    asked = _file_under(queries, "q_embedding", centroids, probes)
    near = stage(_ranked(_grid(asked, filed, ["user_id", "_dim", "_list"], k, None), k), "near")
    enough = near.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("query_id")
    best = near
    if probes < lists:
        short = stage(queries.join(enough, "query_id", "left_anti"), "short")
        if not short.isEmpty():
            rest = _ranked(_grid(short, vectors, ["user_id", "_dim"], k, None), k)
            best = near.join(enough, "query_id", "left_semi").unionByName(rest)
    return _with_columns(best, stored, carry)


def _sampled(df: DataFrame, key: str, column: str, rows: int) -> dict[int, np.ndarray]:
    """At most ``rows`` vectors, by order of a hash of their key: unit rows by length of vector."""
    head = df.select("_dim", column).orderBy(F.xxhash64(key), key).limit(rows).toArrow()
    return {
        dim: _unit(head.filter(pc.equal(head.column("_dim"), dim)).column(column)) for dim in pc.unique(head.column("_dim")).to_pylist()
    }


def _trained(vectors, queries, k: int, lists: int, target: float, seed: int) -> tuple[dict[int, np.ndarray], int]:
    """(centroids by length of vector, lists to look into), both from bounded samples."""
    sample, asked = _sampled(vectors, "id", "embedding", SAMPLE), _sampled(queries, "query_id", "q_embedding", SAMPLE_PROMPTS)
    centroids, missed = {}, np.zeros(lists + 1)
    for dim, x in sample.items():
        centroids[dim] = c = _k_means(x, lists, seed)
        q = asked.get(dim)
        if q is None:
            continue
        home = np.argmax(np.round(x @ c.T, _DIGITS), axis=1)
        sims = np.round(q @ x.T, _DIGITS)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-np.round(q @ c.T, _DIGITS), axis=1, kind="stable"), axis=1, kind="stable")
        at = np.take_along_axis(place, home[top], axis=1).ravel()
        missed += np.bincount(at, minlength=lists + 1)
    share = np.cumsum(missed) / max(missed.sum(), 1)
    return centroids, int(np.searchsorted(share, target)) + 1 if missed.any() else lists


def _k_means(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses all its vectors starts again at one that is far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]]
    if len(c) < lists:
        c = np.concatenate([c, rng.standard_normal((lists - len(c), x.shape[1]))])
    for _ in range(rounds):
        sims = np.round(x @ c.T, _DIGITS)
        home = np.argmax(sims, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=lists) == 0)
        far = np.argsort(sims.max(axis=1), kind="stable")[:len(empty)]
        sums[empty[:len(far)]] = x[far]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def _vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows with a vector; only vectors of one length (``_dim``) are compared."""
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0)).withColumn("_dim", F.size(column))


def _with_columns(best: DataFrame, stored: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The hits, written down so that Spark knows their size, with ``carry`` columns of their memories."""
    if not carry:
        return best
    return stage(best, "nearest").join(stored.select("user_id", "id", *carry), ["user_id", "id"])


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    best = top_rows(parts, ["query_id"], [F.desc("cosine"), "id"], k)
    return best.withColumn("distance", F.lit(1.0) - F.col("cosine"))


def _fetch_small(queries: DataFrame) -> pa.Table:
    """The prompts, which must be at most SMALL_QUERIES; never reads more than one row beyond."""
    head = queries.limit(SMALL_QUERIES + 1).toArrow()
    if head.num_rows > SMALL_QUERIES or head.nbytes > SMALL_BYTES:
        raise ValueError(f"few_prompts takes at most {SMALL_QUERIES} prompts of {SMALL_BYTES} bytes together")
    return head


def _unit(column) -> np.ndarray:
    """A list column as unit rows in double precision; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _first_per_group(group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k entries of each run of equal values."""
    n = len(group)
    at = np.arange(n)
    start = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    return np.nonzero(at - np.maximum.accumulate(np.where(start, at, 0)) < k)[0]


def _block_best(q: np.ndarray, m: np.ndarray, k: int, floor: float | None):
    """Best k columns per row of q·mᵀ, ties to the smaller column: (rows, columns, cosines)."""
    out = []
    step = min(_SLICE, max(1, _SLICE_VALUES // len(m)))
    for lo in range(0, len(q), step):
        sims = np.round(q[lo : lo + step] @ m.T, _DIGITS)
        cut = np.full((len(sims), 1), -np.inf if floor is None else floor)
        if k < sims.shape[1]:
            cut = np.maximum(cut, np.partition(sims, -k, axis=1)[:, -k:].min(axis=1, keepdims=True))
        rows, cols = np.nonzero(sims >= cut)
        cos = sims[rows, cols]
        order = np.lexsort((cols, -cos, rows))
        order = order[_first_per_group(rows[order], k)]
        out.append((rows[order] + lo, cols[order], cos[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _hit_schema(queries: DataFrame, memories: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("user_id", memories.schema["user_id"].dataType),
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", memories.schema["id"].dataType),
            T.StructField("cosine", T.DoubleType()),
        ]
    )


def _scan(small: pa.Table, queries, memories, k, floor) -> DataFrame:
    """Few prompts: read the memories once, where they lie, and keep a running top-k per task."""
    ids = small.column("query_id").combine_chunks()
    mine: dict = {}  # by user, then by vector length: the positions of the prompts and their unit vectors
    keys = list(zip(small.column("user_id").to_pylist(), small.column("_dim").to_pylist()))
    for user, dim in sorted(set(keys)):
        at = np.array([i for i, key in enumerate(keys) if key == (user, dim)])
        mine.setdefault(user, {})[dim] = at, _unit(small.column("q_embedding").take(pa.array(at)))

    def best_of(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held)
        t = t.take(
            pc.sort_indices(t, sort_keys=[("_q", "ascending"), ("cosine", "descending"), ("id", "ascending")])
        )
        return t.take(pa.array(_first_per_group(t.column("_q").to_numpy(), k)))

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            for user in pc.unique(batch.column("user_id")).to_pylist():
                for dim, (asked, vectors) in mine.get(user, {}).items():
                    here = pc.and_(pc.equal(batch.column("user_id"), user), pc.equal(batch.column("_dim"), dim))
                    block = pa.Table.from_batches([batch]).filter(here).sort_by("id")
                    if not block.num_rows:
                        continue
                    r, c, cos = _block_best(vectors, _unit(block.column("embedding")), k, floor)
                    hit = block.select(["user_id", "id"]).take(pa.array(c))
                    hit = hit.append_column("_q", pa.array(asked[r])).append_column("cosine", pa.array(cos))
                    held.append(hit)
                    rows += hit.num_rows
                if rows > 4 * k * len(ids) + 100_000:
                    held = [best_of(held)]
                    rows = held[0].num_rows
        if held:
            t = best_of(held)
            t = t.append_column("query_id", ids.take(t.column("_q").combine_chunks()))
            yield from t.select(["user_id", "query_id", "id", "cosine"]).to_batches()

    # Reaches the scan: only the users who ask are read.
    memories = memories.where(F.col("user_id").isin(sorted(mine)))
    return memories.mapInArrow(task, _hit_schema(queries, memories))


def _grid(queries, memories, keys, k, floor) -> DataFrame:
    """Many prompts: a grid of (prompt block, memory block) cells per group, one task call per cell."""
    def blocks_of(rows: int, values: int):
        return F.ceil(F.count("*") / F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(values) / F.col("_dim"))))).cast("int")

    asked = queries.groupBy(*keys).agg(blocks_of(QUERY_BLOCK, QUERY_VALUES).alias("_nq"))
    stored = memories.groupBy(*keys).agg(blocks_of(MEMORY_BLOCK, MEMORY_VALUES).alias("_nm"))
    # Written down, so that Spark knows how small it is; groups without a prompt drop out here.
    blocks = stage(asked.join(stored, keys), "search-blocks")
    cells = [*keys, "_qb", "_mb"]
    left = (
        queries.join(blocks, keys)
        .withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"))
        .withColumn("_mb", F.explode(F.sequence(F.lit(0), F.col("_nm") - 1)))
        .select(*cells, "query_id", "q_embedding")
    )
    right = (
        memories.join(blocks, keys)
        .withColumn("_mb", F.pmod(F.xxhash64("id"), F.col("_nm")).cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .select(*cells, "id", "embedding")
    )
    schema = _hit_schema(queries, memories)
    names = schema.names

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], (left if n == "query_id" else right).schema.field(n).type)
                             if n != "cosine" else pa.array([], pa.float64()) for n in names})
        right = right.sort_by("id")
        r, c, cos = _block_best(_unit(left.column("q_embedding")), _unit(right.column("embedding")), k, floor)
        hit = right.select(["user_id", "id"]).take(pa.array(c))
        hit = hit.append_column("query_id", left.column("query_id").take(pa.array(r)))
        return hit.append_column("cosine", pa.array(cos)).select(names)

    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, schema)


def _file_under(df: DataFrame, column: str, centroids: dict[int, np.ndarray], n: int) -> DataFrame:
    """Add ``_list``: one row for each of the n centroids nearest to the vector. A length of vector without centroids has one list."""
    schema = T.StructType([*df.schema.fields, T.StructField("_list", T.IntegerType())])

    def task(batches):
        for batch in batches:
            for dim in pc.unique(batch.column("_dim")).to_pylist():
                part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column("_dim"), dim))
                x = _unit(part.column(column))
                known = centroids.get(dim, np.zeros((1, dim)))
                near = np.argsort(-np.round(x @ known.T, _DIGITS), axis=1, kind="stable")[:, :n]
                t = part.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                t = t.append_column("_list", pa.array(near.ravel().astype(np.int32)))
                yield from t.to_batches()

    return df.mapInArrow(task, schema)
