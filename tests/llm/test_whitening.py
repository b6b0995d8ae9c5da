"""Whitening against numpy's own eigenvectors, and the pieces of the eigensolver on hard matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrid.llm import whitening


def test_components_of_hard_matrices():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectra = {
        "spread": np.arange(40.0), "clusters": np.repeat([9.0, 9.0 - 1e-9, 4.0, 1.0], 10), "rank one": np.r_[1.0, np.zeros(39)], "equal": np.ones(40),
        "negative": np.linspace(-3, 3, 40), "great": np.arange(40) * 1e12, "small": np.arange(40) * 1e-12, "zero": np.zeros(40),
    }
    for name, e in spectra.items():
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.components(a, 6)
        size = max(np.abs(e).max(), 1e-290)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:6], atol=1e-12 * size), name
        assert np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-10, name
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * size, name
    for n in (1, 2, 3):
        a = np.diag(np.arange(1.0, n + 1))
        values, vectors = whitening.components(a, n)
        assert np.allclose(values, np.arange(n, 0, -1)) and np.allclose(np.abs(vectors), np.eye(n)[::-1])
    diagonal, off, _ = whitening.tridiagonal(np.diag([1.0, 2, 3, 4]) + 1)
    assert [whitening.below(diagonal, off, x) for x in (0, 1.2, 100)] == [0, int((np.linalg.eigvalsh(np.diag([1.0, 2, 3, 4]) + 1) < 1.2).sum()), 4]


def brute(rows, k=4):
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in keep]
    d = max(sizes, key=lambda s: (sizes.count(s), s))
    keep = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in keep if len(v) == d]
    fit = sorted({x for _, x in keep})
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[x[j] - s[j] / n for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
    out = {}
    for i, x in keep:
        y = np.array([x[j] - s[j] / n for j in range(d)])
        dev = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        for c, (e, v) in enumerate(zip(values, vectors, strict=True), 1):
            if e > 1e-9:
                out.setdefault((i, c), []).append((n, dev, abs(float(y @ v / math.sqrt(e))), e / np.trace(z.T @ z / n)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    good = [(i, (rng.standard_normal(9) * np.arange(1, 10)).tolist()) for i in range(300)]
    return [
        *good, (7, good[9][1]), (1000, good[3][1]), (1001, good[3][1]), (None, good[5][1]), (1002, None), (1003, []), (1004, [1.0] * 8), (1005, [None] + [1.0] * 8), (1006, [float("nan")] * 9), (1007, [float("inf")] + [0.0] * 8),
        (1008, [-1 / 256] * 9), (1009, [0.0] * 9), (1010, [-0.0] * 9), *[(2000 + i, [0.5] * 9) for i in range(300)],
    ]


def test_whitening(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit(1)).repartition(5)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert 0 <= r["identity_error"] < 1e-10
    assert found.keys() == want.keys()
    for key, some in want.items():
        for a, b in zip(sorted(found[key]), sorted(some), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 and abs(a[3] - b[3]) < 1e-10


def test_whitening_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).collect() == []  # no variance, nothing to scale by
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in sorted(two)] == [(i, 1, 2, 512**2, 1.0, 1.0) for i in (1, 2, 3)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0])], schema)).collect()
    assert len(one) == 2 and {r["component"] for r in one} == {1}
