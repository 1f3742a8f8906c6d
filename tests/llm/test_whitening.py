"""Whitening against the eigenvectors of the whole covariance, and exact sums in Python's integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from qscore.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int"


def plain(vectors):
    """n, deviations, centred rows, eigenvalues (falling) and eigenvectors (columns)."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], axes[:, ::-1]


def check(df, vectors, components=8):
    n, deviation, centred, values, axes = plain(vectors)
    rows = df.collect()
    found = sorted({r.component for r in rows})
    assert found == list(range(1, len(found) + 1)) and len(rows) == n * len(found)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    z = np.zeros((n, len(found)))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for k in range(len(found)):
        want = centred @ axes[:, k] / values[k] ** 0.5
        assert min(np.abs(z[:, k] - want).max(), np.abs(z[:, k] + want).max()) < 1e-6
    error = np.abs(np.cov(z.T, bias=True) - np.eye(len(found))).max()
    assert abs(rows[0].identity_error - error) < 1e-9 and error < 1e-9
    return len(found)


@pytest.mark.parametrize("d,n", [(5, 40), (24, 700)])
def test_components_are_those_of_the_covariance(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(n, d)) * np.geomspace(1, 0.02, d) @ rng.normal(size=(d, d)) + rng.normal(size=d)).tolist()
    vectors += vectors[:7]
    df = spark.createDataFrame([(i, v, 9) for i, v in enumerate(vectors)], SCHEMA).repartition(6)
    assert check(whitening.whiten(df), vectors) == min(d, 8)


def test_far_apart_variances_keep_their_digits(spark):
    """Standard deviations from 1e5 to 0.5 after scaling: their squares span eleven digits."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    vectors = (rng.normal(size=(4000, 8)) * np.geomspace(100, 5e-3, 8) @ turn).tolist()
    df = spark.createDataFrame([(i, v, 9) for i, v in enumerate(vectors)], SCHEMA)
    assert check(whitening.whiten(df), vectors) == 8


def test_short_rank_gives_fewer_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, size=(60, 2))
    vectors = (np.hstack([base, base.sum(1, keepdims=True), base * 2, np.full((60, 1), 5)]) / 1.0).tolist()
    df = spark.createDataFrame([(i, v, 9) for i, v in enumerate(vectors)], SCHEMA)
    assert check(whitening.whiten(df), vectors) == 2
    three = [[1.0, 0.0, 0.0, 0.0, 0.5], [0.0, 2.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 3.0, 0.0]]
    assert check(whitening.whiten(spark.createDataFrame([(i, v, 9) for i, v in enumerate(three)], SCHEMA)), three) == 2


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rng = random.Random(6)
    good = [(i, [rng.random() for _ in range(3)]) for i in range(30)] + [(None, [0.1, 0.2, 0.3]), (5, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [1.0, -inf, 1.0]), (105, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], SCHEMA).withColumn("whitened", F.lit("x"))
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 3 * len(good) and {r.n for r in rows} == {len(good)}
    assert sorted({str(r.vec_id) for r in rows}) == sorted({str(i) for i, _ in good})
    assert len([r for r in rows if r.vec_id == 5]) == 9
    for none in (df.limit(0), df.where("vec_id >= 100"), df.where("vec_id = 3"), df.where("vec_id = 5 and embedding[0] = 1")):
        out = whitening.whiten(none)
        assert out.count() == 0 and out.schema["vec_id"].dataType.simpleString() == "bigint"


def test_triangular_solve():
    rng = np.random.default_rng(1)
    factor, rows = np.triu(rng.normal(size=(9, 9))) + 4 * np.eye(9), rng.normal(size=(20, 9))
    assert np.allclose(whitening.solved(rows, factor) @ factor, rows)
