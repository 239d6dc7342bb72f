"""Whitening against numpy's eigenvectors of the whole covariance matrix."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm.queries import op13_jacobi_davidson
from evalmill.llm.whitening import Fit, jacobi_davidson, minres, whitened

from .helpers import SF

VECTORS = "vec_id long, embedding array<float>"


def plain(rows):
    """{vec_id: x}, n, S, mean, eigenvalues and vectors (falling) of usable rows."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    length = max(len(v) for _, v in good)
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (length - len(v))) for i, v in good]
    fit = np.array(sorted({v for _, v in x}), dtype=np.float64)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), [int(s) for s in fit.sum(axis=0)], values[::-1], vectors[:, ::-1]


def compared(df, got, components=4, places=1e-9):
    x, n, sums, values, vectors = plain([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    have = got.collect()
    k = min(components, len(sums), int((values > len(sums) * 1e-15 * values.sum()).sum()))
    assert len(have) == len(x) * k
    want = sorted((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in x for c in range(k))
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in have) == want
    for c in range(k):
        own = sorted((r.vec_id, abs(r.whitened)) for r in have if r.component == c + 1)
        plainly = sorted((i, abs((np.array(v) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]))) for i, v in x)
        assert np.allclose([a for _, a in own], [a for _, a in plainly], rtol=places, atol=places)
        assert [r.explained for r in have if r.component == c + 1] == pytest.approx([values[c] / values.sum()] * len(x), rel=1e-12)
    assert len({r.identity_error for r in have}) <= 1 and all(r.identity_error < 1e-10 for r in have)


def drawn(n, length, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    scale = spread / np.arange(1, length + 1) ** 0.5
    return [(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((n, length)) * scale + rng.standard_normal(length))]


@pytest.mark.parametrize("length,gap", [(1, 0.5), (3, 0.5), (5, 0.5), (40, 0.5), (40, 1e-6), (300, 0.5), (300, 1e-7)])
def test_solver(length, gap):
    """Leading pairs to double precision, near-equal eigenvalues too."""
    rng = np.random.default_rng(length)
    q, _ = np.linalg.qr(rng.standard_normal((length, length)))
    real = np.sort(rng.random(length))[::-1].copy()
    real[:4] = [2, 2 - gap, 1.4, 1.4 - gap][: len(real[:4])]
    matrix = (q * real) @ q.T
    calls = []
    values, vectors = jacobi_davidson(lambda v: calls.append(1) or matrix @ v, length, min(4, length))
    assert np.allclose(values, np.sort(real)[::-1][:4], rtol=1e-13)
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 2e-13 * real.max()
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert len(calls) < 200


def test_equal_eigenvalues():
    values, vectors = jacobi_davidson(lambda v: v * np.array([3.0, 3, 3, 1, 1, 1, 1, 0.5, 0, 0])[:, None], 10, 4)
    assert np.allclose(values, [3, 3, 3, 1], rtol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    matrix, shifts = a + a.T, np.array([0.3, 5.0, -2.0])
    q, _ = np.linalg.qr(rng.standard_normal((30, 3)))
    right = rng.standard_normal((30, 3))
    got = minres(lambda v: matrix @ v, shifts, q, right, np.full(3, 1e-12), 60)
    project = np.eye(30) - q @ q.T
    for k in range(3):
        assert np.allclose(project @ (matrix - shifts[k] * np.eye(30)) @ project @ got[:, k], project @ right[:, k], atol=1e-7)


def test_products_are_those_of_the_covariance(spark):
    rows = spark.createDataFrame([([k, -k * k, 7],) for k in range(-50, 50)] * 2, "x array<bigint>").repartition(7)
    fit = Fit(rows)
    x = np.array([[k, -k * k, 7] for k in range(-50, 50)], dtype=float)
    cov = np.cov(x.T, bias=True)
    assert fit.n == 100 and fit.sums == [int(s) for s in x.sum(axis=0)]
    assert np.allclose(fit.product(np.eye(3)), cov, rtol=1e-12) and fit.trace() == pytest.approx(np.trace(cov), rel=1e-13)


def test_random_vectors(spark):
    rows = drawn(400, 24)
    df = spark.createDataFrame(rows + [(k + 1000, rows[3][1]) for k in range(300)], VECTORS).repartition(9)
    compared(df, whitened(df))


def test_odd_rows(spark):
    rows = drawn(40, 6, 5)
    rows += [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [float("nan")] * 6), (54, [float("inf")] * 6), (55, [0.5, -0.25]), (1, rows[1][1]), (1, rows[2][1]), rows[7]]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("x", "vec", "n", "component", "data", "whitened", "pos", "col"):
        df = df.withColumn(name, F.lit("?"))
    compared(df, whitened(df))


def test_few_directions(spark):
    """Fewer components where vectors span fewer; none for one vector, an empty table, empty vectors."""
    line = spark.createDataFrame([(k, [float(k), 0.0, 2.0 * k]) for k in range(9)], VECTORS)
    compared(line, whitened(line))
    for rows in ([(1, [0.5, 1.0])] * 3, [], [(1, [])], [(1, None)]):
        assert whitened(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_large_entries(spark):
    """Exact deviations where 64 bits do not hold the way to them; null where they do not hold the result."""
    rng = random.Random(3)
    df = spark.createDataFrame([(k, [rng.uniform(-1, 1) * 2**17, rng.uniform(-1, 1) * 2**10]) for k in range(64)], VECTORS)
    compared(df, whitened(df))
    huge = spark.createDataFrame([(k, [rng.uniform(-1, 1) * 2**60, 1e30]) for k in range(20)], VECTORS)
    assert {r.deviation for r in whitened(huge).collect()} == {None}


def test_query(spark):
    compared(spark.read.parquet(f"{SF}/embeddings.parquet"), op13_jacobi_davidson(spark, SF))
