import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qscore.llm import quality, toxicity
from qscore.llm.queries import QUERIES
from qscore.llm.samples import labelled, remainder

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    scored = QUERIES[name](spark, SF).where("held_out")
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select(label, "score", "predicted").collect()
    y, s, p = (np.array([r[i] for r in rows]) for i in range(3))
    assert ((0 <= s) & (s <= 1)).all()
    return y, p


def test_held_out_toxicity(spark):
    y, p = held_out(spark, "op10_toxicity", "toxic")
    # About one toxic label in ten is on a text without a toxic word.
    assert p[y == 1].mean() >= 0.75 and p[y == 0].mean() <= 0.01


def test_held_out_quality(spark):
    y, p = held_out(spark, "op8_quality", "quality")
    assert p[y == 1].mean() >= 0.98 and p[y == 0].mean() <= 0.05


def test_remainder(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 5, -7, 123456789, None)], "doc_id long")
    got = rows.select("doc_id", remainder("doc_id", 4)).collect()
    assert all(r[1] == zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 4 for r in got)


def test_sample_is_bounded_and_repeatable(spark, make_docs):
    docs = make_docs(*[(i, f"text {i}") for i in range(200)], (3, "text 3"), (None, "no id"))
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    once = labelled(docs, labels, "toxic", F.lit(True), 10).collect()
    assert len(once) == 20 and {r.label for r in once} == {0, 1}
    again = labelled(docs.repartition(5), labels.repartition(3), "toxic", F.lit(True), 10).collect()
    assert sorted(once) == sorted(again)


def test_odd_rows(spark, odd_docs, make_docs):
    train = make_docs(*[(100 + i, "you idiot thing" if i % 2 else "a kind thing") for i in range(40)])
    docs = odd_docs.unionByName(train, allowMissingColumns=True)
    labels = spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    for operator, name in ((toxicity.learn_and_score, "toxicity"), (quality.learn_and_score, "quality")):
        out = operator(docs, labels, F.lit(True))
        assert out.count() == docs.count() and out.where(f"{name} is null or {name} < 0 or {name} > 1").count() == 0
        same = out.where("text is null or text = ''").select(name).distinct()
        assert same.count() == 1
        assert operator(docs.limit(0), labels, F.lit(True)).count() == 0
        none = operator(docs, labels.limit(0), F.lit(True))
        assert {round(r[0], 9) for r in none.select(name).distinct().collect()} == {0.5}


def plain_marginals(lines, pairs):
    """All labellings of a short chain."""
    from itertools import product

    total, good = 0.0, np.zeros(len(lines))
    for labels in product((0, 1), repeat=len(lines)):
        score = sum(x / 2 if k else -x / 2 for x, k in zip(lines, labels))
        p = np.exp(score + sum(pairs[a][b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    return good / total


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    lengths, pairs = np.array([1, 5, 3, 7, 2]), rng.normal(size=(2, 2))
    lines = rng.normal(size=lengths.sum()) * 2
    got, counts = quality._Chains(lengths).marginals(lines, pairs)
    ends = np.cumsum(lengths)
    for end, n in zip(ends, lengths):
        assert np.allclose(got[end - n : end], plain_marginals(lines[end - n : end], pairs))
    assert np.isclose(counts.sum(), (lengths - 1).sum())


def test_chains_are_the_same_together_or_alone():
    rng = np.random.default_rng(4)
    w = rng.normal(size=quality._WIDTH)
    texts = [b"A line.\nWEIRD!! LINE!!\nmore | of | it\n" * k for k in range(1, 6)]
    x = [quality._around(quality._lines(t)[0]) @ w for t in texts]
    n = np.array([len(v) for v in x])
    together, _ = quality._Chains(n).marginals(np.concatenate(x), np.eye(2))
    alone = np.concatenate([quality._Chains(np.array([len(v)])).marginals(v, np.eye(2))[0] for v in x])
    assert np.allclose(together, alone)


def test_texts_are_held_up_to_a_number_of_lines(spark, make_docs, monkeypatch):
    texts = [None, "", "One line.", "x | y\n" * 40, "A good line of words.\n" * 7, "WEIRD!! LINE!!\n" * 90]
    docs = make_docs(*enumerate(texts * 5))
    weights = list(np.random.default_rng(5).normal(size=quality._WIDTH + 4))
    whole = {r.doc_id: r.quality for r in quality.score(docs, weights).collect()}
    for most in (1, 50, 300):
        monkeypatch.setattr(quality, "_HELD", most)
        parts = {r.doc_id: r.quality for r in quality.score(docs.coalesce(1), weights).collect()}
        assert parts.keys() == whole.keys()
        assert np.allclose([parts[i] for i in whole], [whole[i] for i in whole])


def plain_ftrl(samples, alpha, beta, l1, l2, epochs):
    """One coordinate after the other, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for buckets, label in samples:
            w = {i: weight(i) for i in buckets}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in buckets:
                before = n.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i) != 0.0}


@pytest.mark.parametrize("parameters", [{"l1": 0.0}, {"l1": 0.7, "alpha": 0.3, "l2": 0.2, "epochs": 3}, {"l1": 50.0}])
def test_ftrl_gives_the_weights_of_a_plain_version(spark, parameters):
    rng = np.random.default_rng(6)
    words = ["you", "idiot", "kind", "thing", "the", "Stupid!", "day", "sun"]
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(words, size=rng.integers(0, 9)))
        rows.append((i, text, int("idiot" in text or "Stupid" in text)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    hasher = toxicity._Hasher()
    ordered = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
    constant = 1 << toxicity.BITS
    samples = [
        ([*sorted({int(b) for part in toxicity._buckets(hasher.words(t)) for b in part}), constant], y) for _, t, y in ordered
    ]
    expected = plain_ftrl(samples, **(toxicity._PARAMETERS | parameters))
    got = toxicity.fit(sample, **parameters)
    assert got.keys() == expected.keys() and (len(got) > 20) == (parameters["l1"] < 50)
    assert all(math.isclose(got[i], expected[i], rel_tol=1e-9, abs_tol=1e-12) for i in got)


def test_sample_is_the_same_whatever_order_rows_come_in(spark):
    from pyspark.sql import functions as F

    from qscore.llm.samples import labelled

    docs = spark.range(200).selectExpr("id % 40 AS doc_id", "if(id % 9 = 0, null, concat('text ', id)) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    samples = [
        sorted(map(tuple, labelled(rows, labels, "toxic", F.lit(True), 10).collect()), key=str)
        for rows in (docs, docs.orderBy(F.desc("text")).coalesce(1), docs.repartition(7, "text"))
    ]
    assert samples[0] == samples[1] == samples[2]
    assert len(samples[0]) == len({r[0] for r in samples[0]}) == 20 and all(r[2] == r[0] % 2 for r in samples[0])
