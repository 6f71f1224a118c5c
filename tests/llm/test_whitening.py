"""Whitening against exact integers and numpy's eigenvectors, with broken, repeated, wide and odd vectors."""

import numpy as np
import pytest

from sparkmem.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, deviation string, whitened int, code binary"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, b"c") for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors):
    x = np.floor(np.array(vectors) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return x, n, total, values[order], components[:, order]


def test_whitening_follows_the_covariance_of_the_distinct_vectors(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(400, 12)) * np.linspace(1, 0.2, 12)).tolist()
    good += good[:150]  # repeated vectors count once
    broken = [None, [None] + [0.0] * 11, [float("nan")] * 12, [float("inf")] * 12]
    df = table(spark, good + broken + [[0.5] * 3, []])
    model = whitening.fit_whitening(df)
    x, n, total, values, components = plain(good)
    assert (model.n, model.sums) == (n, total.tolist())
    assert np.allclose(model.eigenvalues, values[:4], rtol=1e-12)
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-12)
    assert np.allclose(np.abs((components[:, :4] * model.components).sum(0)), 1, atol=1e-12)
    assert model.identity_error < 1e-10
    rows = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    assert sorted(rows) == [*range(len(good)), len(good) + 4, len(good) + 5]
    z = (x - total / n) @ model.components / np.sqrt(model.eigenvalues)
    for i in range(len(good)):
        assert rows[i].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
        assert np.allclose(rows[i].whitened, z[i], atol=1e-9)
        assert rows[i].code == b"c"
    assert all(rows[len(good) + i].whitened is None and rows[len(good) + i].deviation is None for i in (4, 5))


def test_partitions_do_not_matter(spark):
    vectors = np.random.default_rng(5).normal(size=(300, 6)).tolist()
    a, b = (whitening.fit_whitening(table(spark, vectors).repartition(k)) for k in (1, 7))
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.components, b.components, atol=1e-9)


@pytest.mark.parametrize("vectors, rank", [([[1.0, 2.0, 3.0]] * 5, 0), ([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0, 0.0]], 1)])
def test_components_beyond_the_rank_give_nothing(spark, vectors, rank):
    df = table(spark, vectors)
    model = whitening.fit_whitening(df)
    assert (model.eigenvalues > 0).sum() == rank and len(model.eigenvalues) == 3 and model.identity_error < 1e-9
    assert all(r.whitened[rank:] == [0.0] * (3 - rank) for r in whitening.whiten(df, model).collect())


def test_wide_entries_stay_exact(spark):
    vectors = [[1e15, -3.0, 0.1], [-1e15, 2.0, 0.2], [7e14, 1.0, 0.3], [1e300, 0.0, 0.0]]
    df = table(spark, vectors)
    model = whitening.fit_whitening(df)
    assert model.sums[0] == int((1e15 - 1e15 + 7e14) * 256) + (1 << 62) and model.n == 4
    assert {r.deviation for r in whitening.whiten(df, model).collect()} == {None}  # no longs


def test_nothing_to_learn_from(spark):
    for vectors in ([], [None], [[]], [[float("nan")]]):
        df = table(spark, vectors)
        model = whitening.fit_whitening(df)
        assert len(model.eigenvalues) == 0
        assert whitening.whiten(df, model).count() == (vectors == [[]])


def test_factor_and_rotation_on_graded_matrices():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 40):
        a = rng.normal(size=(d, d)) * np.logspace(0, -6, d)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-13 * v.max())
        turned = whitening.rotated(factor)
        inner = turned.T @ turned
        norms = np.sqrt(np.diag(inner))
        assert np.abs(inner / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-12
        assert np.allclose(turned @ turned.T, v, atol=1e-12 * v.max())


def test_query_has_a_row_for_each_vector_and_component(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [*rng.normal(size=(60, 5)).tolist(), None, [None] * 5]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = whitening.op11_embedding_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in range(60) for k in (1, 2, 3, 4)]
    by = {k: np.array([r.whitened for r in rows if r.component == k]) for k in (1, 2, 3, 4)}
    assert all(abs(v.var() - 1) < 1e-9 for v in by.values()) and {r.n for r in rows} == {60}
