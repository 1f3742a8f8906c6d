"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qscore.shared import materialize

_ROUNDS = 100


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Within a task: gives both ends of each link (a, b) the smallest label that links lead to."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label[:] = label[label]


def _digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Every round writes its edges, so lineage stays short and a lost executor costs one round. A node
    may have any number of edges: minima are combined before they are shuffled, and both sides of each
    join are read from tables, so that Spark splits the partition of a node with very many edges.
    """
    now = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = _digest(now)
    for _ in range(_ROUNDS):
        if not seen[0]:
            break
        # Large star: the larger neighbours of a node go to the smallest node around it.
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            now.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "stars")
        large = now.join(least, now["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = materialize(small, "edges")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centers = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centers)
