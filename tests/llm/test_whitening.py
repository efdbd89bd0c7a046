"""Whitening against Python's integers and numpy's float64, and every odd case."""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from brineframe.llm.whitening import cross, limbs, scatter, whitened

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(k, v, "x", None) for k, v in enumerate(vectors)], SCHEMA).repartition(parts)


def brute(vectors):
    x = [[floor(Fraction(c) * 1024) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)], [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]


def test_products_are_exact():
    random = np.random.default_rng(0)
    for size in (1, 1 << 10, 1 << 19, (1 << 19) - 1, 1 << 40, 1 << 61):
        x = np.concatenate([random.integers(-size, size + 1, (40, 3)), [[size, -size, 0]]])
        assert (sum(part.astype(np.int64).astype(object) << 20 * k for k, part in enumerate(limbs(x))) == x.astype(object)).all()
        assert (cross(x) == x.astype(object).T @ x.astype(object)).all()


@pytest.mark.parametrize("scale", [0.2, 3e6, 1e12])
def test_scatter_and_deviation_are_exact(spark, scale):
    vectors = (np.random.default_rng(1).normal(7, 1, (57, 5)) * scale).tolist()
    n, s, matrix, deviations = brute(vectors)
    for shift in (0, 100000, -31):
        found = scatter(table(spark, vectors), shift=shift)
        assert found.n == n and found.matrix.tolist() == matrix
        assert [int(v) for v in found.sums] == [v - n * shift for v in s]
    got = whitened(table(spark, vectors)).where("component = 2").select("vec_id", "n", "deviation").collect()
    assert sorted((r[0], r[1], int(r[2])) for r in got) == [(k, n, v) for k, v in enumerate(deviations)]


@pytest.mark.parametrize("d, n", [(12, 200), (5, 60), (9, 9)])
def test_components(spark, d, n):
    random = np.random.default_rng(d)
    vectors = (random.normal(0, 1, (n, d)) * np.linspace(1, 3, d)).astype(np.float32).astype(float)
    x = np.floor(vectors * 1024) + 100000
    x -= x.mean(0)
    values, axes = np.linalg.eigh(x.T @ x / n)
    got = whitened(table(spark, vectors.tolist())).toPandas().sort_values(["vec_id", "component"])
    k = min(d, 8)
    assert len(got) == n * k
    some = [j for j in range(k) if values[::-1][j] > 1e-6]
    white, own = got["whitened"].to_numpy(float).reshape(n, k)[:, some], x @ axes[:, ::-1][:, some] / np.sqrt(values[::-1][some])
    signs = np.sign((white * own).sum(0))
    assert np.abs(white * signs - own).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:k], np.maximum(values[::-1][:k], 0) / values.sum(), rtol=1e-9, atol=1e-12)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(len(some))).max() < 1e-9 and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_odd_tables(spark):
    assert whitened(table(spark, [])).count() == 0
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [0.0, -inf]]
    assert whitened(table(spark, odd)).count() == 0
    good = [[1.0, 2.0], [1.0, 2.0], [4.0, 2.5], [0.5, -1.0]]
    alone, mixed = (whitened(table(spark, v)).drop("vec_id").toPandas().sort_values(["component", "whitened"]).to_numpy() for v in (good, odd + good))
    assert (alone == mixed).all()
    # null and repeated keys are vectors of their own
    rows = [(None, good[0]), (None, good[1]), (5, good[2]), (5, good[3])]
    assert whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 8
    # no variance at all, or in one dimension only
    same = whitened(table(spark, [[3.0, 1.0]] * 4)).collect()
    assert len(same) == 8 and all(r["whitened"] is r["explained"] is r["identity_error"] is None and r["deviation"] == 0 for r in same)
    flat = whitened(table(spark, [[1.0, 3.0], [2.0, 3.0], [5.0, 3.0]])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and abs(r["identity_error"]) < 1e-12 for r in flat)
    assert {r["component"]: r["explained"] for r in flat} == {1: 1.0, 2: 0.0}


@pytest.mark.parametrize("vectors", [[[1.0, 2.0], [1.0]], [[1e16, 2.0]]])
def test_what_does_not_fit_is_an_error(spark, vectors):
    with pytest.raises(Exception, match="of one table have one length|don't fit"):
        whitened(table(spark, vectors, 1)).collect()
