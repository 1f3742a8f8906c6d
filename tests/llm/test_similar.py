"""SimHash, embeddings and connected components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qscore.llm import embeddings, simhash
from qscore.llm.components import components


def plain_components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                changed |= label[x] != low
                label[x] = low
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(100)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_are_those_of_brute_force(spark, make_docs):
    rng = random.Random(3)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts[10 * i] = " ".join(words)
        for k in range(rng.randrange(4)):
            words[rng.randrange(200)] = f"z{k}"
            texts[10 * i + k + 1] = " ".join(words)
    texts |= {900: "", 901: None, 902: "Ä b", 903: "ä b", 904: "A  B", 905: "a b"}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = plain_components(texts, links)
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(*texts.items())).collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in simhash.keep_first(make_docs(*texts.items())).collect()}
    assert kept == set(want.values()) and len(kept) < len(texts)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_join_all_close_fingerprints(spark, block, monkeypatch):
    rng = random.Random(block)
    center = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)}
    prints |= {center ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(150)}
    monkeypatch.setattr(simhash, "_BLOCK", block)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    for e in edges:
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 64
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert plain_components(signed, [(e.a, e.b) for e in edges]) == plain_components(signed, close)


def test_more_blocks_find_the_same(spark):
    for expected in (10, 1 << 25, 1 << 33):
        masks = simhash._keys(4, expected)
        rng = random.Random(expected)
        for _ in range(200):
            flips = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not flips & m for m in masks)


def test_rows_without_id_link_and_are_dropped(make_docs):
    rng = random.Random(20)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts, prints = [" ".join(base)], [plain_fingerprint(" ".join(base))]
    while len(texts) < 3:  # a chain whose ends are further apart than the radius
        step = texts[-1].split()
        step[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        p = plain_fingerprint(" ".join(step))
        if 0 < (p ^ prints[-1]).bit_count() <= 4 and (len(texts) < 2 or (p ^ prints[0]).bit_count() > 4):
            texts, prints = [*texts, " ".join(step)], [*prints, p]
    other = " ".join(f"x{i}" for i in range(90))
    docs = make_docs((1, texts[0]), (None, texts[1]), (3, texts[2]), *[(None, other)] * 3, (5, texts[0]), (5, other), (1, "own words"))
    got = simhash.near_duplicates(docs).collect()
    assert [r.component_id for r in got if r.doc_id == 3] == [1]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "5", "5", "5"]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == sorted([(1, texts[0]), (1, "own words"), (5, other)])
    alone = simhash.keep_first(make_docs(*[(None, other)] * 2, (None, texts[0]), (None, texts[1]))).collect()
    assert [r.text for r in alone].count(other) == 2 and len(alone) == 3


def test_odd_documents(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    # The null text without doc_id links with the texts without words; the other one is alone.
    assert sorted((r.component_id is None, r.fp == 0) for r in got.where("doc_id is null").collect()) == [(False, True), (True, False)]
    assert {r.component_id for r in got.where("doc_id in (1, 2, 3)").collect()} == {1}
    kept = simhash.keep_first(odd_docs)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(odd_docs.columns)
    assert kept.where("doc_id = 4").count() == 2 and [r.text for r in kept.where("doc_id is null").collect()] == ["no id at all"]
    assert kept.where("doc_id in (6, 9)").count() == 0
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert simhash.keep_first(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 1024])
def test_embedding_links(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "_BLOCK", block)
    rng = np.random.default_rng(8)
    vectors = list(rng.normal(size=(300, 48)))
    for center in rng.normal(size=(12, 48)):
        vectors += list(center + rng.normal(size=(30, 48)) * rng.uniform(0.05, 0.35))
    vectors += [vectors[-1]] * 40
    x = np.array(vectors, np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), "label") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.98 * near.sum()
    want = plain_components(range(len(x)), np.argwhere(near).tolist())
    same = sum(got[i].component_id == want[i] for i in want)
    assert same >= 0.98 * len(want)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_odd_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [1.0, 0.01]), (None, None),
        (11, [1e-30, 0.0]), (12, [3e38, 0.0]), (13, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    assert all(by[i].n_links == 0 and by[i].kept for i in (1, 2, 3, 4, 5, 6, 9, 13))
    assert all(by[i].n_links == 4 and by[i].component_id == 7 for i in (7, 8, 11, 12))
    assert by[10].n_links == 1 and by[10].kept
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id is None and r.component_id) == [(4, 7)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert embeddings.near_duplicates(rows).count() == rows.count()
    # A fraction of cosines is made high by adding noise to the table's own vectors.
    noisy = rows.select(
        (F.col("vec_id") + 10_000).alias("vec_id"),
        F.transform("embedding", lambda v, i: v + 0.02 * F.sin(i.cast("double") + F.col("vec_id"))).cast("array<float>").alias("embedding"),
    )
    both = rows.select("vec_id", "embedding").unionByName(noisy)
    v = both.collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.9).sum()) - len(x)
    assert embeddings.near_duplicates(both).agg(F.sum("n_links")).first()[0] >= 0.9 * true > 0
