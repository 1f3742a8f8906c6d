"""SimHash near duplicates: 64-bit fingerprints, linked through BK-trees.

Fingerprints that differ in at most ``radius`` bits agree in whole blocks of bits: of m blocks, m - radius
at least. Every choice of m - radius blocks makes a shard of the fingerprints that agree there, and every
linked pair meets in a shard. A shard is a BK-tree (the children of a node are keyed by their distance to
it), and a search for a fingerprint follows only the edges whose key is within the radius of its own
distance. Trees of a task are built and searched together, level by level, as arrays.

Trees are not broadcast as a whole, as their number grows with the data: a tree and its searches meet by
the shuffle. A shard of more than ``_BLOCK`` fingerprints is cut into blocks, and each pair of blocks is a
tree and its searches on its own, so that no task holds a hot shard. Copies count once, and a task
gives a spanning forest of the links it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from qscore.llm.common import packed, unpacked
from qscore.llm.components import components, settle
from qscore.operators.fetch import without
from qscore.shared import materialize

_SEED = 42
_BLOCK = 4096
_ROWS = 50_000  # fingerprints that a task searches at once
_FRONTIER = 4_000_000  # (search, node) pairs that a task holds at once
_SLICE = 1 << 16


def _fingerprint(text: bytes | None, words: int) -> int:
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        stop = at + _SLICE
        hashes = np.array(
            [digest(joined[a:b], _SEED) for a, b in zip(starts[at:stop], ends[at:stop])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str = "text", words: int = 4) -> Column:
    """The SimHash of a text's shingles, as a signed long. Words are lower-cased (A-Z only); a text of
    fewer words is one shingle, a text without words (or null) has fingerprint 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, words) for t in texts], dtype="int64")

    return simhash(F.col(text).cast("binary"))


def _keys(radius: int, expected: int) -> list[list[int]]:
    """Masks: (bits that two fingerprints of a shard share). More blocks, and so more but smaller shards, where
    there are more fingerprints; every choice finds the same links."""
    blocks = radius + (1 if expected < 1 << 24 else 2 if expected < 1 << 32 else 3)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the trees (``tree`` is sorted), and children by node and distance (-1: none)."""
    child = np.full((len(fps), 65), -1, np.int32)
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    root = first[np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1]
    rest = np.setdiff1d(np.arange(len(fps)), first, assume_unique=True)
    parent = root[rest]
    while len(rest):
        key = parent * 65 + np.bitwise_count(fps[rest] ^ fps[parent])
        keys, at, back = np.unique(key, return_index=True, return_inverse=True)
        child.reshape(-1)[keys] = rest[at]
        on = np.ones(len(rest), bool)
        on[at] = False
        parent, rest = rest[at][back][on], rest[on]
    return root, child


def _linked(fps: np.ndarray, tree: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the first one that links lead to within its tree."""
    root, child = _forest(fps, tree)
    label = np.arange(len(fps))
    step = max(1, _FRONTIER // int(np.bincount(np.unique(tree, return_inverse=True)[1]).max()))
    for start in range(0, len(fps), step):
        search = np.arange(start, min(start + step, len(fps)))
        node, found = root[search], []
        while len(search):
            far = np.bitwise_count(fps[search] ^ fps[node]).astype(np.int64)
            hit = (far <= radius) & (node < search)
            found.append((search[hit], node[hit]))
            nexts = []
            for key in range(-radius, radius + 1):
                at = far + key
                ok = (at >= 0) & (at <= 64)
                below = child[node[ok], at[ok]]
                nexts.append((search[ok][below >= 0], below[below >= 0]))
            search, node = (np.concatenate(x) for x in zip(*nexts))
        a, b = (np.concatenate(x) for x in zip(*found))
        settle(label, a, b)
    return label


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            tree = rows.groupby(["mask", "key", "i", "j"], sort=False).ngroup().to_numpy()
            fps = rows["fp"].to_numpy()
            label = _linked(fps.view(np.uint64), tree, radius)
            other = np.flatnonzero(label != np.arange(len(fps)))
            return pd.DataFrame({"a": fps[other], "b": fps[label[other]]}).drop_duplicates()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < _ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows[["mask", "key", "i", "j"]] == rows[["mask", "key", "i", "j"]].iloc[-1]).all(axis=1)
            held = [rows[last]]
            if not last.all():
                yield links(rows[~last])
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run


def links(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that differ in at most
    ``radius`` bits."""
    total = fingerprints.count()
    masks = _keys(radius, total)
    shards = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                for i, m in enumerate(masks)
            ]
        )
    )
    rows = fingerprints.select("fp", shards.alias("_s")).select("fp", "_s.mask", "_s.key")
    large = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _BLOCK)
    large = materialize(
        large.select("mask", "key", F.ceil(F.col("_n") / _BLOCK).cast("int").alias("_blocks")), "hot-shards"
    )
    dealt = rows.join(large, ["mask", "key"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "mask"), F.col("_blocks")).cast("int")
    dealt = dealt.withColumn("_own", own).withColumn("_with", F.explode(F.expr("sequence(0, _blocks - 1)")))
    dealt = dealt.select(
        "fp", "mask", "key", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j")
    )
    # A shard of one has no links.
    group = ["mask", "key", "i", "j"]
    alone = F.count(F.lit(1)).over(Window.partitionBy(*group))
    dealt = dealt.repartition(*group).withColumn("_n", alone).where("_n > 1").drop("_n")
    return dealt.sortWithinPartitions(*group).mapInPandas(_search(radius), "a long, b long").distinct()


def _with_least(prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """``prints`` with ``_least``: the minimum of ``least`` over all rows that links lead to."""
    classes = materialize(prints.groupBy("fp").agg(F.min(least).alias("_own")), "simhash-classes")
    labels = materialize(components(links(classes.select("fp"), radius)), "simhash-components")
    smallest = labels.join(classes, labels["node"] == classes["fp"]).groupBy("component").agg(F.min("_own").alias("_least"))
    smallest = materialize(smallest, "simhash-smallest")
    moved = materialize(labels.join(smallest, "component").select(F.col("node").alias("fp"), "_least"), "simhash-moved")
    of_class = classes.join(moved.withColumn("_moved", F.lit(True)), "fp", "left").select(
        "fp", F.when(F.col("_moved"), F.col("_least")).otherwise(F.col("_own")).alias("_least")
    )
    return prints.join(materialize(of_class, "simhash-of-class"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that can be reached over fingerprints that differ
    in at most ``radius`` bits, the document's own included.

    Needs doc_id and text and looks at nothing else. Texts without words, null among them, have fingerprint
    0 and link like any other. A row without doc_id links like any other and has the component_id of the rows it
    links with: null where none of them has a doc_id. Repeated rows are all returned. An empty table gives no rows.
    """
    prints = materialize(docs.select("doc_id", fingerprint("text", words).alias("fp")), "simhash")
    found = _with_least(prints, F.col("doc_id"), radius)
    return found.select("doc_id", "fp", F.col("_least").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest doc_id stays, or, where
    no row of it has a doc_id, one text; of texts that share that doc_id, one by a hash. Every row of what stays
    stays, where rows repeat doc_id and text."""
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")
    prints = materialize(docs.select("doc_id", hashed, fingerprint("text", words).alias("fp")), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    gone = _with_least(prints, row, radius).where(~row.eqNullSafe(F.col("_least")))
    gone = materialize(gone.select("doc_id", "_text").distinct(), "simhash-gone")
    rows = packed(docs, ("doc_id", "text")).withColumn("_text", hashed)
    return without(rows, gone, ("doc_id", "_text")).select(*unpacked(docs.columns, ("doc_id", "text")))
