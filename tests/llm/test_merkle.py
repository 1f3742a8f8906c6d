"""The Merkle manifest against a plain version that builds every tree as lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from qscore.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return plain_digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """The root, and for every node its siblings as (left, right) at each step."""
    ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, merged = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in groups[at + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(plain_digest(*run))
            merged.append(sum(groups[at : at + 3], []))
        nodes, groups = parents, merged
    return nodes[0], ways


def plain_fold(node, way):
    for left, right in way:
        node = plain_digest(left, node, right)
    return node


def plain_manifest(rows, told):
    """Sorted rows of (doc_id, leaf, subroot, root, siblings, folded) from (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], []
    for s in order:
        leaves = [(r[0] is not None, r[0] or 0, plain_leaf((r[0], r[3], r[2], r[4], r[1])), r) for r in groups[s]]
        leaves.sort(key=lambda x: x[:3])
        root, ways = plain_tree([x[2] for x in leaves])
        subroots.append(root)
        inner.append((leaves, ways))
    root, upper = plain_tree(subroots)
    out = []
    for (leaves, ways), subroot, up in zip(inner, subroots, upper):
        for (*_, leaf, r), way in zip(leaves, ways):
            copy = plain_leaf((r[0], r[3], r[2], r[4], told(r)))
            out.append((r[0], leaf, subroot, root, "".join(a + b for a, b in way + up), plain_fold(copy, way + up)))
    return sorted(out, key=str)


def _spark_rows(docs, told):
    found = merkle.manifest(docs, "doc_id", "source", FIELDS, {"text": told} if told is not None else None)
    found = found.select(
        "doc_id", F.col("leaf").cast("string"), F.col("subroot").cast("string"), F.col("root").cast("string"),
        merkle.proof(F.col("way")), merkle.fold(F.col("told_leaf"), F.col("way")).cast("string"),
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def _told(r):
    return r[1] if r[1] is None or (r[0] or 0) % 2 else r[1].replace("\n", "")


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_trees_are_those_of_lists(spark, monkeypatch, depth):
    """Small blocks make several tiers of one tree, with last runs of every size and lone last nodes."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(depth)
    rows = []
    for source, n in ((None, 5), ("", 1), ("a", 90), ("b", 27), ("c", 28), ("d", 9), ("é", 3), ("z", 2), ("\U0001f600", 10)):
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "ü\n" * 3, "plain", "x" * 3000])
            rows.append((rng.randrange(10**6), text, rng.choice([None, "en"]), source, rng.choice([None, 3])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    assert _spark_rows(docs, told) == plain_manifest(rows, _told)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = [(i, f"t{i}", "en", f"s{i % 100}", 1) for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _spark_rows(docs, None) == plain_manifest(rows, lambda r: r[1])


def test_what_is_untouched_folds_to_the_root(spark, odd_docs):
    found = merkle.manifest(odd_docs, "doc_id", "source", FIELDS)
    assert found.count() == odd_docs.count()
    assert found.where(merkle.fold(F.col("told_leaf"), F.col("way")) != F.col("root")).count() == 0
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _spark_rows(odd_docs, None) == plain_manifest(rows, lambda r: r[1])
    assert merkle.manifest(odd_docs.limit(0), "doc_id", "source", FIELDS).count() == 0


def test_one_row_is_its_own_root(make_docs):
    row = merkle.manifest(make_docs((7, "only")), "doc_id", "source", FIELDS).first()
    assert row.leaf == row.subroot == row.root and row.way == []
    framed = F.concat(merkle.framed(F.lit("")), merkle.framed(F.lit(None)), merkle.framed(F.lit("é")), merkle.framed(F.lit(-5)))
    assert bytes(make_docs((1, "")).select(framed).first()[0]) == "0:-2:é2:-5".encode()
