"""Whitening against numpy's dense eigensolver; the solver on hard spectra; odd rows."""

import math

import numpy as np
import pytest

from tessera.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, whitened string, x int"


def dense(rows):
    """Distinct x vectors, eigenvalues and eigenvectors of their covariance, by numpy."""
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in r) for r in rows}), dtype=np.float64)
    z = x - x.mean(0)
    e, u = np.linalg.eigh(z.T @ z / len(x))
    return x, e[::-1], u[:, ::-1]


def spectrum(d, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    full = np.concatenate([values, np.zeros(d - len(values))]) if len(values) < d else np.asarray(values)
    a = (q * full) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("d,values", [
    (64, np.linspace(1, 2, 64)[::-1]), (64, 2.0 ** -np.arange(64)), (200, np.linspace(1, 5, 200)[::-1]), (300, 1 / np.arange(1, 301) ** 2),
    (5, [5.0, 4, 3, 2, 1]), (1, [2.0]), (40, np.ones(40)), (50, [3.0, 2, 1]), (30, [0.0]),
    (120, np.concatenate([[10.0, 10, 10, 9.999999], np.linspace(1, 2, 116)[::-1]])),
])
def test_solver(d, values):
    a = spectrum(d, values)
    calls = []
    e, u, worst = w.jacobi_davidson(lambda q: calls.append(q.shape[1]) or a @ q, d, 16, subspace=48)
    k, want = min(16, d), np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.abs(e - want[:k]).max() <= 1e-13 * max(1e-300, want[0])
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    assert np.abs(a @ u - u * e).max() <= 1e-12 * max(1e-300, want[0])
    assert worst <= 2 * w.tolerance(d)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    a = spectrum(30, np.concatenate([np.linspace(-3, -1, 10), np.linspace(1, 4, 20)]))
    shift = np.array([0.1, -0.2, 0.3, 0.0])
    b = rng.standard_normal((30, 4))
    b[:, 3] = 0
    x = w.minres(lambda y: a @ y - shift * y, b, steps=60, tol=1e-12)
    assert np.abs(a @ x - shift * x - b).max() < 1e-8 and not x[:, 3].any()


def check(got, rows):
    x, e, u = dense([r for _, r in rows])
    n, d = x.shape
    sums = x.sum(0)
    k = min(16, d, int((e > 1e-9 * e[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id is not None) == sorted((i, c) for i, _ in rows if i is not None for c in range(1, k + 1))
    by = {r.vec_id: {} for r in got}
    signs = {}
    for r in got:
        by[r.vec_id][r.component] = r
        assert r.n == n and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    for i, vec in rows:
        xi = [math.floor(64 * c) + 1_000_000 for c in vec]
        want = (np.array(xi) - sums / n) @ u[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            r = by[i][c + 1]
            assert r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(xi, sums))
            if abs(want[c]) > 1e-3:
                signs.setdefault(c, round(r.whitened / want[c]))
            assert abs(r.whitened - signs.get(c, 1) * want[c]) < 1e-7


def test_against_dense(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((24, 24)) * np.linspace(0.2, 3, 24)
    rows = [(i, (rng.standard_normal(24) @ mix).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a frequent vector counts once
    odd = [(5000, None), (5001, [None] * 24), (5002, [math.nan] + [0.0] * 23), (5003, [math.inf] * 24), (5004, []), (5005, [1.0] * 7), (5006, [1e30] * 24)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + odd], SCHEMA).repartition(5)
    check(w.whitened_embeddings(df).collect(), rows)


def test_few_vectors_and_dimensions(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(30)]
    check(w.whitened_embeddings(spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)).collect(), rows)
    few = [(i, [float(i), 2.0 * i, 0.0, 1.0]) for i in range(3)]  # rank one
    check(w.whitened_embeddings(spark.createDataFrame([(*r, "a", 1) for r in few], SCHEMA)).collect(), few)
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", 1)] * 4 + [(None, [1.0, 2.0], "a", 1)], SCHEMA)
    assert w.whitened_embeddings(one).count() == 0
    empty = w.whitened_embeddings(one.limit(0))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0


def test_operator_keeps_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11), 1.0], "old", i) for i in range(50)] + [(None, [3.0, 1.0, 2.0], "old", 0)], SCHEMA)
    rows, model, error = w.fit_and_whiten(df, "embedding")
    assert rows.columns == ["vec_id", "embedding", "x", "whitened", "deviation"] and rows.count() == 51
    assert model.dimension == 3 and model.residual <= 2 * w.tolerance(3) and error < 1e-12


def test_deviation_beyond_long():
    big = np.array([[2**40, 1], [2**31, 2**31], [3, 4]], dtype=np.int64)
    assert w._deviations(big) == [None, None, 25]
