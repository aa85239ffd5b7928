"""Whitening against an eigen decomposition of the exact covariance, on odd rows and on badly conditioned ones."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stutter.llm import whitening
from stutter.llm.whitening import whiten

EXTRA = "vec_id long, embedding array<double>, x string, n string, component string, task string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], EXTRA).repartition(3)


def whole(rows, width):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in ok], [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in ok]


def check(spark, rows, width, most=32):
    ids, x = whole(rows, width)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    top = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in top), n**3)) for j in range(width)] for i in range(width)])
    variance, axes = np.linalg.eigh(cov)
    variance, axes = variance[::-1], axes[:, ::-1]
    k = min(most, np.linalg.matrix_rank(np.array(top, float)))
    got = whiten(table(spark, rows), most).collect()
    assert len(got) == n * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert all(r.identity_error < 1e-9 for r in got)
    for r in got:
        assert r.explained == pytest.approx(variance[r.component - 1] / variance.sum(), rel=1e-6)
    want = sorted((str(i), sum(c * c for c in v)) for i, v in zip(ids, top, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == want
    centre = np.array([[float(Fraction(c, n)) for c in v] for v in top])
    for j in range(1, k + 1):
        white = np.sort([r.whitened for r in got if r.component == j])
        mine = centre @ axes[:, j - 1] / np.sqrt(variance[j - 1])
        assert min(np.abs(white - np.sort(mine)).max(), np.abs(white - np.sort(-mine)).max()) < 1e-6


ODD = [(None, [1.0] * 6), (7, None), (8, [1.0, None]), (9, [float("nan")] * 6), (10, [1.0, float("inf")]), (11, []), (12, [0.5]), (12, [0.5])]


def rows(seed, n, scales):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=len(scales)) * scales).tolist()) for i in range(n)]


def test_whiten(spark):
    check(spark, rows(1, 60, [9.0, 5.0, 3.0, 2.0, 1.0, 0.5]) + ODD, 6)
    check(spark, rows(2, 60, [9.0, 5.0, 3.0, 2.0, 1.0, 0.5]), 6, most=2)


def test_badly_conditioned(spark):
    check(spark, rows(3, 40, [2e5, 1e3, 30.0, 0.1]), 4)  # the covariance has condition 1e12


def test_dependent_rows(spark):
    turned = [(i, [a, b, a + b, 1.0, a - 2 * b]) for i, (a, b) in enumerate((x / 64, y / 64) for x in range(9) for y in (x * x, 5, 7 - x))]
    check(spark, turned, 5)


def test_fewer_rows_than_dimensions(spark):
    check(spark, rows(4, 3, [4.0, 3.0, 2.0, 2.0, 5.0]), 5)


def test_without_variance(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(table(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect() == []


def test_beyond_64_bits(spark):
    with pytest.raises(Exception, match="64-bit"):
        whiten(table(spark, [(1, [1e30]), (2, [0.0])])).collect()
    with pytest.raises(Exception, match="64-bit"):
        whiten(table(spark, [(1, [1e9]), (2, [-1e9])])).collect()


def test_sums_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_FAN", 2)
    check(spark, rows(5, 50, [3.0, 2.0, 1.0]), 3)
