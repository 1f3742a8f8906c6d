"""Merkle manifest of a dataset: trees over the documents of each source, and one over the sources.

Leaves are numbered along each source and cut into aligned blocks of 3^6. A block keeps every level of its
part of the tree as one hex string: parents are the hashes of substrings of fixed width, and the siblings on
a leaf's way up are the substrings that flank its run. The roots of blocks are the leaves of the next tier,
until each tree has one block, so no task holds more than a block, however many documents a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qscore.operators.skew import positions
from qscore.shared import materialize

FANOUT = 3
DEPTH = 6  # levels of a block, above its leaves
_DIGEST = 64  # hex digits


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, one after the other, as 64 hex digits in ASCII."""
    return F.sha2(F.concat(*parts), 256).cast("binary")


def framed(value: Column) -> Column:
    """A value with its UTF-8 length before it, so that no two rows give the same bytes; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")).cast("binary")


def _parents(level: Column) -> Column:
    """The next level: the digests of each run of ``FANOUT`` nodes, the last of which may be shorter."""
    width = FANOUT * _DIGEST
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    hashed = F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (tree, pos from 0, node, more): tree, block, members (node, more) in order, the levels
    l0 and up (null above the last), root. A tree of one block ends at one node; all others fill all levels."""
    size = FANOUT**DEPTH
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos")])))
    blocks = (
        nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "block").agg(members.alias("members"))
        .withColumn("l0", F.array_join(F.transform("members", lambda m: m["node"].cast("string")), "").cast("binary"))
    )
    for i in range(DEPTH):
        level = F.col(f"l{i}")
        blocks = blocks.withColumn(f"l{i + 1}", F.when((F.length(level) > _DIGEST) | (F.col("block") > 0), _parents(level)))
    return blocks.withColumn("root", F.coalesce(*[F.col(f"l{i}") for i in range(DEPTH, -1, -1)]))


def _way(at: Column) -> Column:
    """The siblings left and right of a leaf's way up through its block; ``at`` is its place in the block, from 0."""
    steps = []
    for i in range(DEPTH):
        level, place = F.col(f"l{i}"), F.floor(at / FANOUT**i).cast("int")
        within = place % FANOUT
        left = F.substring(level, (place - within) * _DIGEST + 1, within * _DIGEST)
        right = F.substring(level, (place + 1) * _DIGEST + 1, (FANOUT - 1 - within) * _DIGEST)
        steps.append(F.when(F.col(f"l{i + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _unpacked(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Members of ``blocks`` with their ways up; ``above`` (tree, pos, way, more) has those of the blocks. What
    else ``above`` has goes to every member."""
    named = above.select(*[F.col(c).alias(f"_{c}") for c in above.columns])
    joined = blocks.join(named, (blocks["tree"] == named["_tree"]) & (blocks["block"] == named["_pos"]))
    fields = blocks.schema["members"].dataType.elementType.names
    members = F.transform("members", lambda m, i: F.struct(*[m[c].alias(c) for c in fields], _way(i).alias("way")))
    more = [c for c in above.columns if c not in ("tree", "pos", "way")]
    rows = joined.select("tree", "_way", *[F.col(f"_{c}").alias(c) for c in more], F.explode(members).alias("m"))
    return rows.select("tree", *more, *[f"m.{c}" for c in fields], F.concat("m.way", "_way").alias("way"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from those of ``nodes`` to those that hold a tree's root, one for each tree."""
    tiers = [materialize(_blocks(nodes), "merkle-blocks")]
    while tiers[-1].where("block > 0").select("block").take(1):
        roots = tiers[-1].select("tree", F.col("block").alias("pos"), F.col("root").alias("node"))
        tiers.append(materialize(_blocks(roots), "merkle-blocks"))
    return tiers


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes that ``tiers`` were built from, with their ways; ``above`` starts at the roots of the trees."""
    for blocks in reversed(tiers[1:]):
        above = materialize(_unpacked(blocks, above).drop("node"), "merkle-ways")
    return _unpacked(tiers[0], above)


_NO_WAY = "array<struct<left: binary, right: binary>>"


def trees(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos from 0, gapless, node: 64 hex digits, more columns) with ``top``, the root of its tree,
    and ``way``: the siblings (left, right) at each step from the node to it. A lone node is its tree's root."""
    tiers = _tiers(nodes)
    return _down(tiers, tiers[-1].select("tree", F.lit(0).alias("pos"), F.array().cast(_NO_WAY).alias("way"), F.col("root").alias("top")))


def fold(node: Column, way: Column) -> Column:
    """The root that follows from a node and the siblings on its way up."""
    return F.aggregate(way, node, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof(way: Column) -> Column:
    """All siblings of a way, one after the other."""
    return F.array_join(F.flatten(F.transform(way, lambda s: F.array(s["left"].cast("string"), s["right"].cast("string")))), "")


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], told: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, way, told_leaf): each row's leaf, the root of its group, that of the dataset, and
    the siblings from the leaf to it (see :func:`fold` and :func:`proof`).

    A leaf is the digest of the ``fields``, framed, in their order; ``told_leaf`` is that with the columns in
    ``told`` in place of its own, as another copy of the data may tell it. In a group, leaves ascend by ``key``
    (null first), rows of one key by their leaf; groups ascend by their UTF-8 bytes, null first. Any column may
    be null; null and empty differ. Rows that repeat have a leaf each. Other columns are not looked at. An
    empty table gives no rows.
    """
    told = told or {}
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = rows.select(
        F.col(key).alias("key"), tree.alias("tree"), digest(*[framed(F.col(f)) for f in fields]).alias("node"),
        digest(*[framed(told.get(f, F.col(f))) for f in fields]).alias("told"),
    )
    leaves = positions(materialize(leaves, "merkle-leaves"), "tree", ["key", "node", "told"], "pos")
    tiers = _tiers(leaves.withColumn("pos", F.col("pos") - 1))
    groups = tiers[-1].select(F.lit("all").alias("all"), F.col("tree").alias("group"), F.col("root").alias("node"))
    groups = positions(materialize(groups, "merkle-groups"), "all", ["group"], "pos")
    whole = trees(groups.select(F.col("all").alias("tree"), (F.col("pos") - 1).alias("pos"), "node", "group"))
    whole = whole.select(F.col("group").alias("tree"), F.lit(0).alias("pos"), "way", F.col("node").alias("subroot"), "top")
    found = _down(tiers, materialize(whole, "merkle-roots"))
    return found.select(
        F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", F.col("top").alias("root"), "way",
        F.col("told").alias("told_leaf"),
    )
