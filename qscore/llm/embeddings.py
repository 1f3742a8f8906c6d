"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by pseudo-random rotations, each three rounds of random signs and a fast Hadamard transform,
and hashed to the axis that it then lies nearest to, with its sign. A table joins a few such axes into a
bucket. Vectors that point the same way share a bucket in most tables; to need fewer tables, a vector is
also looked for in the buckets that have its second-nearest axis in one place. Pairs that meet in a
bucket are verified by their cosine.

Equal vectors count as one with their number. A bucket gives one row per vector (how many it links to) and
a spanning forest of its links, not the pairs; a pair that meets more than once counts where it meets
first, which both vectors' bucket codes tell. A bucket of more than ``_BLOCK`` rows is cut into blocks, and
pairs of blocks are compared on their own, so that no task holds a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from qscore.llm.components import components, settle
from qscore.shared import materialize

_BLOCK = 1024
_SEED = 20_240_601


def _shape(vectors: int) -> tuple[int, int]:
    """Axes per bucket, and tables: more and so smaller buckets for more vectors, with as many more tables as
    keep the share of pairs that meet."""
    axes = 1 if vectors < 4_096 else 2 if vectors < 1 << 20 else 3
    return axes, {1: 6, 2: 12, 3: 24}[axes]


def _rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    n = x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        step = 1
        while step < n:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
            step *= 2
        x = x / np.sqrt(n)
    return x


def bucket_codes(unit: np.ndarray, axes: int, tables: int) -> np.ndarray:
    """Codes by vector, table and probe; probe 0 is the bucket that the vector lies in."""
    n, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    out = np.zeros((n, tables, 1 + axes), np.int64)
    every = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for a in range(axes):
            turned = _rotate(padded, np.random.default_rng((_SEED, size, t, a)))
            order = np.argpartition(-np.abs(turned), 1, axis=1)[:, :2]
            values = np.abs(turned[every[:, None], order])
            swap = values[:, 1] > values[:, 0]
            order[swap] = order[swap][:, ::-1]
            axis = 2 * order + (turned[every[:, None], order] < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
        for probe in range(1 + axes):
            code = np.zeros(n, np.int64)
            for a in range(axes):
                code = code * (2 * size) + (second[a] if probe == a + 1 else best[a])
            out[:, t, probe] = code
    return out


def _hash(axes: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                x = np.array(rows["embedding"].to_list(), dtype=np.float64).reshape(len(rows), -1)
                # Scaled first, so that squares neither overflow nor vanish.
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                codes = bucket_codes(unit, axes, tables).reshape(len(rows), -1)
                yield pd.DataFrame({"k": rows["k"], "m": rows["m"], "dim": dim, "unit": list(unit), "codes": list(codes)})

    return run


def _meets(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether vectors with these codes of one table meet in the bucket of x, and in that of y."""
    hx, hy = x[:, 0], y[:, 0]
    return (y == hx[:, None]).any(1), (x == hy[:, None]).any(1)


def _compare(least: float, axes: int):
    key = ["dim", "t", "code", "i", "j"]

    def group(rows: pd.DataFrame, tables_seen: int, code: int, cross: bool) -> tuple:
        unit = np.stack(rows["unit"].to_numpy())
        codes = np.stack(rows["codes"].to_numpy()).reshape(len(rows), -1, 1 + axes)
        home, own, m = rows["home"].to_numpy(), rows["own"].to_numpy(), rows["m"].to_numpy()
        lying = np.flatnonzero(home)
        if not len(lying):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = unit[lying] @ unit.T >= least
        a, b = np.nonzero(near)
        a = lying[a]
        ok = (a != b) & (~home[b] | (a < b))
        if cross:
            ok &= own[a] != own[b]
        a, b = a[ok], b[ok]
        first = np.ones(len(a), bool)
        for t in range(tables_seen):
            one, other = _meets(codes[a, t], codes[b, t])
            first &= ~(one | other)
        one, other = _meets(codes[a, tables_seen], codes[b, tables_seen])
        twice = one & other
        first &= ~twice | (np.minimum(codes[a, tables_seen, 0], codes[b, tables_seen, 0]) == code)
        return a[first], b[first]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            rows = rows.reset_index(drop=True)
            for (_, t, code, i, j), part in rows.groupby(key, sort=False):
                a, b = group(part, t, code, i != j)
                if not len(a):
                    continue
                ids, m = part["k"].to_numpy(), part["m"].to_numpy()
                links = np.zeros(len(part), np.int64)
                np.add.at(links, a, m[b])
                np.add.at(links, b, m[a])
                label = np.arange(len(part))
                settle(label, a, b)
                some = np.flatnonzero(links)
                out.append(pd.DataFrame({"a": ids[some], "b": ids[label[some]], "n": links[some]}))
            return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            rows = pd.concat(held, ignore_index=True)
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.zeros(0, bool)
            held = [rows[last]]
            if not last.all():
                yield found(rows[~last])
        if held and len(held[0]):
            yield found(held[0])

    return run


def _usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors found with cosine ``least`` or more), component_id (the smallest vec_id
    that links lead to, the own included) and kept (vec_id = component_id).

    ``vectors`` has vec_id and embedding, an array of float or double; other columns are not looked at.
    Vectors that are null, zero or empty or hold nulls or anything not finite link with nothing, nor do
    vectors of different lengths with each other. Repeated rows are vectors of their own and link. A row
    without vec_id links like any other but is never kept and names no component, unless it stands alone:
    then its component is null. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", _usable(F.col("embedding")).alias("_ok"), "embedding")
    rows = rows.withColumn("k", F.when(F.col("_ok"), F.xxhash64("embedding")))
    classes = rows.where("_ok").groupBy("k").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep")
    )
    classes = materialize(classes.withColumn("dim", F.size("embedding")), "vectors")
    total = classes.count()
    axes, tables = _shape(total)
    hashed = classes.select("k", "m", "dim", "embedding").mapInPandas(
        _hash(axes, tables), "k long, m long, dim int, unit array<double>, codes array<long>"
    )
    hashed = materialize(hashed, "vector-codes")
    probes = 1 + axes
    put = hashed.select("k", "m", "dim", "unit", "codes", F.posexplode("codes").alias("_p", "code"))
    put = put.withColumn("t", F.expr(f"_p div {probes}").cast("int")).withColumn("home", F.col("_p") % probes == 0)
    bucket = ["dim", "t", "code"]
    large = put.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _BLOCK)
    large = materialize(large.select(*bucket, F.ceil(F.col("_n") / _BLOCK).cast("int").alias("_blocks")), "hot-buckets")
    dealt = put.join(large, bucket, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("k", "t"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.expr("sequence(0, _blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "_with")).withColumn("j", F.greatest("own", "_with"))
    key = [*bucket, "i", "j"]
    # Buckets that hold one vector have no pairs.
    dealt = dealt.select(*key, "k", "m", "unit", "codes", "home", "own").repartition(*key)
    dealt = dealt.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n > 1").drop("_n")
    found = dealt.sortWithinPartitions(*key).mapInPandas(_compare(least, axes), "a long, b long, n long")
    found = materialize(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("links"))
    labels = materialize(components(found.select("a", "b").distinct()), "vector-components")
    smallest = labels.join(classes, labels["node"] == classes["k"]).groupBy("component").agg(F.min("rep").alias("smallest"))
    smallest = materialize(smallest, "vector-smallest")
    of_node = materialize(labels.join(smallest, "component").select(F.col("node").alias("k"), "smallest"), "vector-of-node")
    of_class = (
        classes.select("k", "m", "rep").join(counts, "k", "left").join(of_node, "k", "left")
        .select(
            "k", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.coalesce("smallest", "rep").alias("component"),
        )
    )
    of_class = materialize(of_class, "vector-classes")
    out = rows.select("vec_id", "k").join(of_class, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
