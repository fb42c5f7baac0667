"""Whitening against numpy's eigensolver and plain Python arithmetic."""

import math

import numpy as np
import pytest

from quire.llm import queries, whitening


def _plain(vectors):
    """(fit, n, S, V) of lists of floats, in whole numbers as long as possible."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, total)] for r in fit])
    return x, n, total, centred.T @ centred / n


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_eigenpairs_of_random_matrices(d):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((d, 3 * d + 1)) * rng.uniform(0.01, 100, (d, 1))
    m = m @ m.T
    values, vectors = whitening.eigenpairs(m, 16)
    true = np.linalg.eigvalsh(m)[::-1][:16]
    assert np.allclose(values, true, rtol=1e-11, atol=1e-13 * true[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * true[0]


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 1, 1, 0.5], [3] * 9, [4, 4 + 1e-9, 4 - 1e-12, 1, 1e-6, 0, 0], [1, 0, 0]])
def test_eigenpairs_of_clusters_and_deficient_matrices(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((d, d)))[0]
    m = (q * values) @ q.T
    found, vectors = whitening.eigenpairs((m + m.T) / 2, d)
    assert len(found) == sum(v > 0 for v in values)
    assert np.allclose(found, sorted((v for v in values if v > 0), reverse=True), atol=1e-13 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.abs(m @ vectors - vectors * found).max() < 1e-12 * max(values)


def test_diagonal_matrix_without_couplings():
    values, vectors = whitening.eigenpairs(np.diag([1.0, 9.0, 4.0, 4.0]), 3)
    assert values.tolist() == pytest.approx([9, 4, 4])
    assert abs(vectors[1, 0]) == pytest.approx(1)


def test_sturm_counts():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(20), rng.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    points = np.linspace(-5, 5, 101)
    assert whitening.below(a, b, points).tolist() == [(values < p).sum() for p in points]


def _check(rows, found):
    x, n, total, v = _plain([r for _, r in rows])
    trace, deviation = np.trace(v), {}
    for (key, _), xs in zip(rows, x):
        deviation[key] = sum((n * a - int(s)) ** 2 for a, s in zip(xs, total))
    true = np.linalg.eigvalsh(v)[::-1]
    k = min(16, int((true > 1e-12 * true[0]).sum()))
    assert len(found) == k * len(rows)
    by_row = {}
    for r in found:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(true[r["component"] - 1] / trace, rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-8
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    first = {}
    for (key, _), xs in zip(rows, x):
        first.setdefault(xs, key)
    w = np.array([[by_row[i][c] for c in range(1, k + 1)] for i in first.values()])
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
    centred = np.array([[float(n * a - int(s)) / n for a, s in zip(xs, total)] for xs in first])
    axes = (centred.T @ w) / n  # V a / sqrt(e) for the axis a of each component
    size = np.linalg.norm(axes, axis=0)
    assert np.allclose(size ** 2, true[:k], rtol=1e-9)
    assert np.abs(v @ (axes / size) - (axes / size) * true[:k]).max() < 1e-9 * true[0]


def test_against_plain_arithmetic(spark, tables):
    table = tables("embeddings")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    _check(rows, queries.op11_whitening(spark, "/root/testdata/sf0.001").collect())


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.25, -3.0], "x"), (2, [0.5, 1.25, -3.0], "x"), (2, [0.5, 1.25, -3.0], "x"), (3, None, "x"), (4, [], "x"),
            (5, [1.0, None, 2.0], "x"), (6, [nan, 1.0, 2.0], None), (7, [1.0, inf, 0.0], "x"), (8, [1.0, 2.0], "x"),
            (None, [2.5, -1.0, 0.25], "x"), (9, [-0.01, 0.0, 7.0], "x"), (10, [3.0, 3.0, 3.5], "x"), (11, [9.0, -4.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(3)
    used = [(i, v) for i, v, _ in rows if v and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    _check(used, whitening.whiten(df).collect())


def test_huge_entries_lose_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (1e9 + rng.standard_normal(5)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _check(rows, whitening.whiten(df).collect())


def test_deviation_beyond_64_bits_is_null_and_one_vector_gives_nothing(spark):
    df = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {None}
    assert whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], df.schema)).count() == 0
    empty = whitening.whiten(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
