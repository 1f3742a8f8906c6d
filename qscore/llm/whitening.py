"""Whitening of vectors by principal components, through a shifted Cholesky QR of the centred rows.

A pass over the rows gives their Gram matrix, its Cholesky factor R, and with it rows Q = Y R^-1 that are
nearly orthogonal; passes are repeated on Q until it is orthonormal, and the factors are composed. The first
factor is taken of the Gram matrix with a small shift, so that it exists for any rows. Components and their
eigenvalues are the right singular vectors and values of the composed R: the Gram matrix itself, whose
eigenvalues have lost half their digits, is never decomposed.

Q is not written: a pass solves for it again from the factors so far. A task holds a batch of rows and one
square matrix; partial matrices are added up row by row, in the order of their partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from qscore.llm.repeats import lean
from qscore.shared import materialize

_EPS = np.finfo(float).eps
_PASSES = 6
_ORTHONORMAL = 1e-13  # times the dimension: what rounding leaves


def whole(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset for each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null and non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _added(parts: DataFrame, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a matrix that ``part`` gives for a batch. Matrices are added within a partition,
    then row by row of the matrix, so that no task and not the driver gets one of every partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                found = part(batch)
                total = found if total is None else total + found
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pd.DataFrame({"i": np.arange(len(total)), "at": at, "v": [np.ascontiguousarray(r).tobytes() for r in total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        total = np.add.accumulate([np.frombuffer(v) for v in rows["v"]])[-1]
        return pd.DataFrame({"i": rows["i"].iloc[:1], "v": [total.tobytes()]})

    added = parts.mapInPandas(run, "i int, at int, v binary").groupBy("i").applyInPandas(add, "i int, v binary")
    rows = added.orderBy("i").collect()  # the square of the dimension, at most
    return np.array([np.frombuffer(r.v) for r in rows])


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows * factor^-1 for an upper triangular factor."""
    out = rows.copy()
    for j in range(len(factor)):
        out[:, j] = (out[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _upper(gram: np.ndarray, shift: float) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
    except np.linalg.LinAlgError:
        return None


def _triangle(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R with R'R = Y'Y of the centred rows Y, by Cholesky factors of repeated Gram passes."""
    factors: list[np.ndarray] = []

    def gram(batch: pd.DataFrame) -> np.ndarray:
        q = np.stack(batch["x"].to_numpy()).astype(float) - mean
        for factor in factors:
            q = solved(q, factor)
        return q.T @ q

    composed, d = np.eye(len(mean)), len(mean)
    for number in range(_PASSES):
        found = _added(rows, gram)
        size = np.trace(found)
        if not size:
            return found
        last = np.abs(found - np.eye(d)).max() <= _ORTHONORMAL * d
        # Batches are added up one by one, so rounding does not grow with n, and neither does the shift.
        factor = None if last else _upper(found, 0.0 if number else 11 * d * (d + 1) * _EPS * size)
        if factor is None:
            # Orthonormal, or short in rank: the directions without rows have no factor, but their own lengths.
            lengths, axes = np.linalg.eigh(found)
            return np.sqrt(np.maximum(lengths, 0))[:, None] * axes.T @ composed
        factors.append(factor)
        composed = factor @ composed
    return composed


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000
) -> DataFrame:
    """(key, component from 1, n, deviation, whitened, explained, identity_error): the rows of ``vectors`` on
    their first principal components, scaled to variance 1.

    Entries become integers x = floor(scale * c) + offset. All rows are fitted: n of them, with sums S. ``deviation``
    is the sum over dimensions of (n x - S)^2, exact; ``whitened`` is x - S/n on a unit eigenvector of the covariance
    (divisor n) over the root of its eigenvalue; ``explained`` is the eigenvalue's share of all; ``identity_error`` is
    how far the covariance of all ``whitened`` is from the identity, at most. Signs make the largest entry of an
    eigenvector positive.

    Left out are vectors that are null, empty, or hold null or non-finite entries, and those whose length is not the
    commonest one (the largest of equals). Components whose variance is zero, up to rounding, are left out, so fewer
    rows than dimensions, or constant vectors, give fewer components; one row gives none. A null key is a key like
    any other, repeated rows count and are returned each. An empty table gives no rows. Where ``deviation`` has more
    than 64 bits, Spark's overflow error is raised. Other columns are not looked at.
    """
    with lean(vectors.sparkSession):
        return _whitened(vectors, key, vector, components, scale, offset)


def _whitened(vectors: DataFrame, key: str, vector: str, components: int, scale: int, offset: int) -> DataFrame:
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(usable(F.col("v")))
    rows = materialize(rows.select("key", whole(F.col("v"), scale, offset).alias("x")), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "key string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    key_type = vectors.schema[key].dataType
    none = vectors.sparkSession.createDataFrame([], schema).select(F.col("key").cast(key_type).alias(key), *schema.replace(",", "").split()[2::2])
    if common is None:
        return none
    rows = rows.where(F.size("x") == common["d"])
    n = common["count"]
    totals = [
        r[0] for r in rows.select(F.posexplode("x").alias("i", "x")).groupBy("i")
        .agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("i").select("s").collect()
    ]
    totals = [int(s) for s in totals]
    mean = np.array([float(Fraction(s, n)) for s in totals])
    _, singular, axes = np.linalg.svd(_triangle(rows, mean))
    # What rounding of the centred entries can make of a direction without variance.
    least = len(mean) * _EPS * (np.abs(mean).max() * n**0.5 + singular.max())
    kept = min(components, int((singular > least).sum()))
    if not kept:
        return none
    axes = axes[:kept] * np.sign(np.take_along_axis(axes[:kept], np.abs(axes[:kept]).argmax(axis=1)[:, None], axis=1))
    variance = singular**2 / n
    onto = axes.T / np.sqrt(variance[:kept])

    @F.pandas_udf("array<double>")
    def projected(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()).astype(float) - mean) @ onto), dtype=object)

    exact = "decimal(38,0)"
    apart = F.zip_with("x", F.array(*[F.lit(str(s)).cast(exact) for s in totals]), lambda x, s: x.cast(exact) * F.lit(n).cast("decimal(19,0)") - s)
    deviation = F.aggregate(apart, F.lit(0).cast(exact), lambda a, b: (a + (b * b).cast(exact)).cast(exact)).cast("long")
    white = materialize(rows.select("key", deviation.alias("deviation"), projected("x").alias("z")), "whitened")

    centre = _added(white, lambda b: np.stack(b["z"].to_numpy()).sum(axis=0)[None])[0] / n

    def spread(batch: pd.DataFrame) -> np.ndarray:
        z = np.stack(batch["z"].to_numpy()) - centre
        return z.T @ z

    error = float(np.abs(_added(white, spread) / n - np.eye(kept)).max())
    share = F.array(*[F.lit(float(e)) for e in variance[:kept] / variance.sum()])
    return white.select("key", "deviation", F.posexplode("z").alias("i", "whitened")).select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
