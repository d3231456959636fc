"""Whitening against a dense eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    sums = x.sum(axis=0)
    n = len(x)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, sums)] for r in x])
    return x, sums, n, centred


def check(rows, vectors, count=32):
    x, sums, n, centred = exact(vectors)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(count, int((e > 1e-12 * max(e[0], 1)).sum()))
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {c for _, c in by} == set(range(1, k + 1))
    want_deviation = ((n * x - sums).astype(object) ** 2).sum(axis=1)
    white = np.zeros((n, k))
    for (i, c), own in by.items():
        for r in own:
            assert r.n == n and r.deviation == want_deviation[i]
            assert abs(r.explained - e[c - 1] / e.sum()) <= 1e-10 * r.explained
            assert r.identity_error <= 1e-4
            white[i, c - 1] = r.whitened
    # the scatter of the whitened rows is what the components say it is
    gaps = np.diff(e[: k + 1]) if k < len(e) else np.append(np.diff(e), 1)
    if np.abs(gaps).min() > 1e-6 * e[0]:
        want = centred @ v[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            sign = np.sign((want[:, c] * white[:, c]).sum())
            assert np.abs(want[:, c] * sign - white[:, c]).max() < 1e-8
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8


def frame(spark, vectors, n=3):
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(n)
    return df.withColumns({c: F.lit(1) for c in ("id", "x", "n", "values", "deviation", "component")})


@pytest.mark.parametrize("shape", [(200, 5), (300, 40), (20, 50), (60, 1)])
def test_random(spark, shape):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal(shape) * np.linspace(1, 3, shape[1])).astype(np.float32)
    check(whitening.whiten_embeddings(frame(spark, vectors)).collect(), vectors)


def test_stops_before_all_dimensions(spark):
    """Fast falling variances settle early; two of them are equal."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 150)) * 0.02
    scales = np.array([60, 40, 25, 25, 9, 5])
    base[:, :6] = rng.choice([-1, 1], (400, 6)) * scales
    both = np.concatenate([base, base * np.where(np.arange(150) == 3, -1, 1)])  # both signs: no correlation of 3
    vectors = both.astype(np.float32)
    passes = []
    kept = whitening._Rows.products
    try:
        whitening._Rows.products = lambda self, y, w: passes.append(1) or kept(self, y, w)
        rows = whitening.whiten_embeddings(frame(spark, vectors), 3).collect()
    finally:
        whitening._Rows.products = kept
    assert len(passes) < 60
    check(rows, vectors, 3)


def test_equal_variances(spark):
    """Every dimension on its own axis: one variance four times, one twice."""
    axes = np.eye(6) * np.array([4, 4, 4, 4, 2, 2])
    vectors = np.concatenate([axes, -axes]).astype(np.float32)
    rows = whitening.whiten_embeddings(frame(spark, vectors)).collect()
    assert {r.component for r in rows} == set(range(1, 7))
    shares = {r.component: r.explained for r in rows}
    assert [round(shares[c] * 72) for c in range(1, 7)] == [16, 16, 16, 16, 4, 4]
    assert max(r.identity_error for r in rows) < 1e-9


def test_locked_components_are_not_found_again(spark):
    """A run that stops early leaves a repeated variance to the next run."""
    wide = np.zeros((40, 20))
    for j in range(20):
        wide[2 * j, j], wide[2 * j + 1, j] = 1, -1
    wide *= np.array([9, 9, 9, 5, 5] + [0.25] * 15)
    fitted = whitening.fit(whitening.integer_vectors(frame(spark, wide.astype(np.float32))), 4)
    x, _, n, centred = exact(wide)
    e = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    assert np.allclose(fitted.variances, e[:4], rtol=1e-12)
    assert np.abs(fitted.components.T @ fitted.components - np.eye(4)).max() < 1e-12


def test_rows_that_are_dropped(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.5], [0.5, 0.5]]
    odd = [None, [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")], [], [1.0], [1.0, 2.0, 3.0], [1e30, 0.0]]
    rows = [(i, v, None) for i, v in enumerate(good)] + [(50 + i, v, None) for i, v in enumerate(odd)]
    got = whitening.whiten_embeddings(spark.createDataFrame([*rows, (None, [7.0, 7.0], 0)], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, None} and len(got) == 10
    assert all(r.n == 5 for r in got)


def test_nothing_to_whiten(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]):
        rows = [(i, v, 0) for i, v in enumerate(vectors)]
        got = whitening.whiten_embeddings(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long():
    x = np.array([[0, 10], [1 << 40, 5]])
    sums = (1 << 40, 15)
    small, large = whitening._deviations(x, 2, sums)
    assert small is None and large is None
    assert whitening._deviations(np.array([[1 << 29, 0], [0, 0]]), 2, (1 << 29, 0)) == [1 << 58, 1 << 58]
