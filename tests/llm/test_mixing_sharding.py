import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qscore.llm import mixing, sharding
from qscore.llm.common import WORD


def plain_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def sources(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        source = rng.choice(["big"] * 6 + ["b", "c", "Z", None, "é"] + ["tiny"] * (i < 3))
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 7, 150, 400])), source))
    rows += [(9000, "x " * 20_000, "c"), (9001, None, "b"), (9002, "only", "one word")]
    return make_docs(*rows, rows[5], rows[5])


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_meets_targets(spark, sources, block):
    sizes = Counter()
    for r in sources.collect():
        sizes[r.source] += len((r.text or "").split())
    want = plain_targets(sizes)
    seen, pieces = mixing.mix(sources, block=block)
    rows = mixing.taken_words(seen, pieces).collect()
    assert len(rows) == sources.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    of = {r.doc_id: r.source for r in sources.collect()}
    taken = Counter()
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    # Every slot holds one block, and every stretch of the schedule holds sources close to their shares.
    slots = {}
    for p in pieces.collect():
        slots.setdefault(p.slot, (p.n, p.rank))
        assert slots[p.slot] == (p.n, p.rank) and 0 < p.words <= block
    assert sorted(slots) == list(range(len(slots))) and len(set(slots.values())) == len(slots)
    if block == 16:
        part = Counter(n for s, (n, _) in slots.items() if s < len(slots) // 2)
        whole = Counter(n for n, _ in slots.values())
        assert all(abs(part[n] - whole[n] / 2) <= 6 for n in whole)


def test_mix_is_repeatable(spark, sources):
    def once(df):
        return sorted(map(tuple, mixing.taken_words(*mixing.mix(df)).collect()))

    assert once(sources) == once(sources.repartition(13))


def test_mixed_documents(spark, sources):
    more = sources.withColumns({n: F.lit(n) for n in ("n", "at", "slot", "_id", "_copy", "size", "target", "words", "rank")})
    out = mixing.mixed_documents(more)
    assert out.columns == more.columns
    got = out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("w")).collect()
    seen, pieces = mixing.mix(sources)
    want = pieces.groupBy("n").agg(F.sum("words").alias("w")).collect()
    assert sorted(r.w for r in got) == sorted(r.w for r in want)
    assert out.where("n_chars != length(text)").count() == 0 and out.where("n != 'n'").count() == 0


def test_mix_of_nothing(spark, sources, odd_docs):
    assert mixing.taken_words(*mixing.mix(sources.limit(0))).count() == 0
    assert mixing.mixed_documents(sources.limit(0)).count() == 0
    empty = sources.where("text = '' or text is null")
    rows = mixing.taken_words(*mixing.mix(empty)).collect()
    assert rows and all(r.taken == r.size == r.target == 0 for r in rows)
    assert mixing.taken_words(*mixing.mix(odd_docs)).count() == odd_docs.count()


def check_shards(out, shards):
    rows = out.select("shard", "slot", "size").collect()
    at = {}
    for r in rows:
        at.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < shards for s in at)
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    sums = Counter({s: 0 for s in range(shards)})
    for r in rows:
        sums[r.shard] += r.size
    return sums


def test_shards_are_even(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 10, 100, 900])) for i in range(4000)] + [(5000 + i, "copy" * 50) for i in range(2000)]
    docs = make_docs(*rows)
    out = sharding.shard_documents(docs, shards=12)
    assert out.count() == len(rows)
    sums = check_shards(out, 12)
    assert max(sums.values()) - min(sums.values()) <= 2 * 916
    # A group larger than a shard is cut; texts that occur a few times are not.
    assert out.where(F.col("text").startswith("copycopy")).select("shard").distinct().count() >= 4
    again = sharding.shard_documents(docs.repartition(7), shards=12, cells=3)
    assert sorted(out.select("doc_id", "shard").collect()) == sorted(again.select("doc_id", "shard").collect())


def test_copies_stay_together(spark, make_docs):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        text = f"text {i} " + "y" * rng.randrange(400)
        rows += [(len(rows) + k, text) for k in range(rng.choice([1, 1, 1, 2, 3]))]
    out = sharding.shard_documents(make_docs(*rows), shards=8, tolerance=0.01)
    sums = check_shards(out, 8)
    mean = sum(sums.values()) / 8
    assert all(abs(s - mean) <= 0.02 * mean for s in sums.values())
    parted = out.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert parted == 0


def test_shards_of_odd_rows(spark, odd_docs):
    out = sharding.shard_documents(odd_docs, shards=3)
    assert out.columns == [c for c in odd_docs.columns if c not in ("shard", "slot", "size")] + ["size", "shard", "slot"]
    assert out.count() == odd_docs.count()
    check_shards(out, 3)
    assert {r[0] for r in out.select("_size").distinct().collect()} == {"_size"}
    assert out.where("text is null and size != 16").count() == 0
    assert sharding.shard_documents(odd_docs.limit(0)).count() == 0
    check_shards(sharding.shard_documents(odd_docs, shards=40), 40)
    assert sharding.shard_documents(odd_docs, shards=1).where("shard != 0").count() == 0
