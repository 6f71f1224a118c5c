"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage
from .common import read_table

#: Entries are counted in steps of 1 / SCALE, so that sums and deviations are exact integers.
SCALE = 256
_LIMIT = 1 << 62
_CELLS = 1 << 20


@dataclass
class Whitening:
    """What is known of the fit list; sizes follow the dimension, never the number of rows."""

    n: int  # distinct vectors
    sums: list[int]  # their exact sum in each dimension
    components: np.ndarray  # dimensions × components: unit vectors by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray  # shares of the whole variance
    identity_error: float  # largest entry of (covariance of the whitened fit list - identity), as measured


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all lists of a column, the length of each list, and whether it is whole: not NULL, all entries finite."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(column.offsets.to_numpy())
    present = np.asarray(column.is_valid())
    entries = column.values[column.offsets[0].as_py():column.offsets[-1].as_py()]
    known = np.asarray(entries.is_valid())
    values = entries.fill_null(0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(values)))])
    ends = np.cumsum(lengths)
    return values, lengths, present & (bad[ends] == bad[ends - lengths])


def _steps(values: np.ndarray) -> np.ndarray:
    """floor(SCALE × entry) as a long; what lies outside the longs is held at ± 2^62."""
    return np.clip(np.floor(values * SCALE), -_LIMIT, _LIMIT).astype(np.int64)


def _batch_vectors(column: pa.Array):
    """(rows, matrix of steps) for each length of vector in a batch, some ``_CELLS`` entries together; only whole vectors."""
    values, lengths, keep = _vectors(column)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[keep]):
        rows = np.flatnonzero(keep & (lengths == size))
        for own in np.array_split(rows, 1 + len(rows) * int(size) // _CELLS):
            yield own, _steps(values[starts[own][:, None] + np.arange(size)])


def _codes(batches):
    """Each distinct vector of a batch as bytes: 2 a dimension where that is enough, else 8."""
    for batch in batches:
        for _, x in _batch_vectors(batch.column(0)):
            narrow = (np.abs(x) < 1 << 15).all(axis=1)
            codes = {r.tobytes() for r in x[narrow].astype("<i2")} | {r.tobytes() for r in x[~narrow].astype("<i8")}
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.shape[1]] * len(codes), pa.int32()), pa.array(list(codes), pa.binary())], ["dims", "code"]
            )


def _decoded(column: pa.Array, dims: int):
    """The matrices a column of codes stands for."""
    codes = column.to_pylist()
    for width, kind in ((2, "<i2"), (8, "<i8")):
        own = [c for c in codes if len(c) == width * dims]
        for a in range(0, len(own), max(1, _CELLS // dims)):
            some = own[a:a + max(1, _CELLS // dims)]
            yield np.frombuffer(b"".join(some), kind).reshape(len(some), dims).astype(np.int64)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n × x - sums, exact: as longs where they hold it, else as Python's integers."""
    widest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if widest < _LIMIT:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _scaled(x, n, sums).astype(np.float64) / n


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor l (dimensions × rank) with l l' = a, for a positive semidefinite: the largest remaining diagonal entry is
    the next pivot, and what is left below the rounding of the first pivot is rank that ``a`` does not have.

    Up to the order of its rows l is lower triangular.
    """
    d = len(a)
    left, factor, order = a.diagonal().copy(), np.zeros((d, d)), np.arange(d)
    least = d * np.finfo(float).eps * left.max(initial=0)
    for k in range(d):
        pivot = k + int(np.argmax(left[order[k:]]))
        order[[k, pivot]] = order[[pivot, k]]
        here, rest = order[k], order[k:]
        if left[here] <= least:
            return factor[:, :k]
        factor[rest, k] = (a[rest, here] - factor[rest, :k] @ factor[here, :k]) / np.sqrt(left[here])
        left[rest] -= factor[rest, k] ** 2
    return factor


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns turned in pairs until all are orthogonal: one-sided Jacobi.

    A round turns disjoint pairs together, in the order of a round robin, so every pair meets once a sweep.
    """
    w = factor.copy()
    r = w.shape[1]
    ring = np.arange(r + r % 2)
    tolerance = len(w) * np.finfo(float).eps
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[:len(ring) // 2], ring[len(ring) // 2:][::-1]
            there = (p < r) & (q < r)
            p, q = p[there], q[there]
            a, b = w[:, p], w[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(alpha * beta)
            angle = np.abs(gamma) / np.where(scale > 0, scale, 1)
            worst = max(worst, float(angle.max(initial=0)))
            turn = angle > tolerance / 4
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(turn, np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            w[:, p], w[:, q] = c * a - c * t * b, c * t * a + c * b
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= tolerance:
            break
    return w


def _summed(parts: DataFrame, keys: list[str], value: str):
    return parts.groupBy(*keys).agg(F.sum(value).alias(value)).collect()


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening:
    """Learn from each distinct vector once (all rows; equal after rounding down to steps of 1 / ``SCALE``).

    Three passes over the written list of distinct vectors: exact sums, the scatter of what is centred by them, and the
    covariance of the whitened list. Each task adds up its own matrix, so the shuffle and the driver meet matrices of the
    dimension squared and no vectors. Rows whose vector is NULL or holds a NULL or a non-finite entry are left out; of
    several vector lengths the one with most distinct vectors counts (the longer of two). Fewer components than asked come
    from fewer dimensions. Components beyond the rank of the data (all vectors equal, say) have eigenvalue 0; an empty table
    has no components.
    """
    unique = stage(df.select(vector).mapInArrow(_codes, "dims int, code binary").distinct(), "vectors")
    sizes = unique.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not sizes or not sizes[0].dims:
        return Whitening(sizes[0]["count"] if sizes else 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    d, n = sizes[0].dims, sizes[0]["count"]
    listed = unique.where(F.col("dims") == d).select("code")

    def add(batches):
        total = [0] * d
        for batch in batches:
            for x in _decoded(batch.column(0), d):
                wide = x.astype(object) if int(np.abs(x).max(initial=0)) > _LIMIT // len(x) else x
                total = [a + int(b) for a, b in zip(total, wide.sum(0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array([str(t) for t in total])})

    exact = listed.mapInArrow(add, "i int, s string").select("i", F.col("s").cast("decimal(38,0)").alias("s"))
    sums = [int(r.s) for r in sorted(_summed(exact, ["i"], "s"))]

    def products(rows: int):
        """Upper triangle of the summed products of a task's rows, as (i, j, s)."""
        above = np.triu_indices(rows)

        def emit(matrix):
            return pa.RecordBatch.from_arrays(
                [pa.array(above[0].astype(np.int32)), pa.array(above[1].astype(np.int32)), pa.array(matrix[above])], ["i", "j", "s"]
            )

        return emit

    def scatter(batches, emit=products(d)):
        total = np.zeros((d, d))
        for batch in batches:
            for x in _decoded(batch.column(0), d):
                y = _centred(x, n, sums)
                total += y.T @ y
        yield emit(total)

    v = np.zeros((d, d))
    for i, j, s in _summed(listed.mapInArrow(scatter, "i int, j int, s double"), ["i", "j"], "s"):
        v[i, j] = v[j, i] = s / n
    turned = rotated(pivoted_cholesky(v))
    eigenvalues = (turned * turned).sum(0)
    order = np.argsort(-eigenvalues)[:components]
    k, rank = min(components, d), len(order)
    values, vectors = np.zeros(k), np.zeros((d, k))
    values[:rank] = eigenvalues[order]
    vectors[:, :rank] = turned[:, order] / np.sqrt(values[:rank])
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    trace = float(np.trace(v))
    model = Whitening(n, sums, vectors, values, values / trace if trace > 0 else values, 0.0)

    def moments(batches, emit=products(rank + 1)):
        total = np.zeros((rank + 1, rank + 1))
        for batch in batches:
            for x in _decoded(batch.column(0), d):
                z = np.column_stack([np.ones(len(x)), _projected(x, model)[:, :rank]])
                total += z.T @ z
        yield emit(total)

    m = np.zeros((rank + 1, rank + 1))
    for i, j, s in _summed(listed.mapInArrow(moments, "i int, j int, s double"), ["i", "j"], "s"):
        m[i, j] = m[j, i] = s / n
    error = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(rank)
    model.identity_error = float(np.abs(error).max(initial=0))
    return model


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    scale = np.where(model.eigenvalues > 0, np.sqrt(model.eigenvalues), 1)
    return _centred(x, model.n, model.sums) @ model.components / scale


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows with a whole vector, with ``deviation`` (long: the exact sum over dimensions of (n × x - S)²) and
    ``whitened`` (array<double>, one entry a component) added; columns of these names are replaced, all others kept.

    Rows whose vector is NULL, or holds a NULL or a non-finite entry, go. A vector of another length than the model's keeps its
    row with NULL in both columns. A deviation that is no long is NULL. Components of eigenvalue 0 give 0. Repeated rows stay repeated.
    """
    kept = [c for c in df.columns if c not in ("deviation", "whitened")]
    at, d, k = kept.index(vector), len(model.sums), len(model.eigenvalues)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for rows, x in _batch_vectors(batch.column(at)):
                own = batch.take(pa.array(rows)).columns
                if x.shape[1] == d:
                    y = _scaled(x, model.n, model.sums)
                    if int(np.abs(y).max(initial=0)) ** 2 * d >= _LIMIT:
                        y = y.astype(object)
                    far = [s if s < 1 << 63 else None for s in (int(s) for s in (y * y).sum(1))] if d else [0] * len(rows)
                    z = pa.array(_projected(x, model).ravel())
                    white = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), z)
                    yield pa.RecordBatch.from_arrays([*own, pa.array(far, pa.int64()), white], schema.names)
                else:
                    none = [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*own, *none], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir):
    """Every whole vector on the four strongest components, one row a vector and component."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    each = [
        F.struct(
            F.lit(i + 1).alias("component"), F.get("whitened", F.lit(i)).alias("whitened"),
            F.lit(float(share)).alias("explained"),
        )
        for i, share in enumerate(model.explained)
    ]
    none = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.inline(F.array(*each) if each else none))
    return rows.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error).alias("identity_error"),
    )
