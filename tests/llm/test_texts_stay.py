"""Texts that stay in the corpus are not shuffled, and a mix moves texts once, at sizes that nothing is broadcast at."""

import random
from collections import Counter

from pyspark.sql import functions as F

from qscore.llm import decontamination, mixing, simhash
from qscore.llm.common import WORD
from qscore.operators import fetch
from tests.test_fetch import no_broadcasts, shuffled_rows


def _texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(n)]


def _moved(df, column="text"):
    return [n for columns, n in shuffled_rows(df) if column in columns]


def test_without_is_the_anti_join(spark):
    schema = "a long, b string, wide string"
    rows = [(i % 900 if i % 11 else None, f"b{i % 40}" if i % 7 else None, f"x{i}") for i in range(4000)]
    rows = spark.createDataFrame(rows + rows[:50], schema)
    gone = rows.where("pmod(hash(wide), 9) = 0").select("b", "a")
    keys = ("a", "b")
    named = gone.toDF("_b", "_a")
    want = rows.join(named, rows["a"].eqNullSafe(named["_a"]) & rows["b"].eqNullSafe(named["_b"]), "left_anti")
    assert 0 < want.count() < rows.count() and want.where("a is null or b is null").count() > 0
    got = fetch.without(rows, gone, keys)
    assert got.columns == rows.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert fetch.without(rows, gone.limit(0), keys).count() == rows.count()
    assert fetch.without(rows.limit(0), gone, keys).count() == 0
    other = gone.withColumn("a", F.col("a").cast("int"))
    assert sorted(map(str, fetch.without(rows, other, keys).collect())) == sorted(map(str, want.collect()))


def test_clean_documents_are_not_shuffled(spark, make_docs):
    texts = _texts(3000)
    item = texts[0]
    leaks = set(range(0, 3000, 100))
    docs = make_docs(*[(i, f"{t} {item}" if i in leaks else t) for i, t in enumerate(texts)], (None, "no id"), (None, None))
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    with no_broadcasts(spark):
        out = decontamination.decontaminate(docs, benchmark)
        moved = _moved(out)
        assert moved and max(moved) <= len(leaks) + 0.05 * 3000
        assert {r.doc_id for r in out.collect()} == {None} | set(range(3000)) - leaks
    assert out.where("doc_id is null").count() == 2


def test_unique_documents_are_not_shuffled(spark, make_docs):
    texts = _texts(2000, seed=4)
    copies = [(5000 + i, texts[i]) for i in range(0, 2000, 50)]
    docs = make_docs(*enumerate(texts), *copies)
    with no_broadcasts(spark):
        out = simhash.keep_first(docs)
        moved = _moved(out)
        assert moved and max(moved) <= len(copies) + 0.05 * len(texts)
        assert {r.doc_id for r in out.collect()} == set(range(2000))


def test_a_mix_moves_texts_once(spark, make_docs):
    rng = random.Random(5)
    rows = [(i if i % 9 else None, t, rng.choice("aab")) for i, t in enumerate(_texts(3000, seed=5))]
    rows += rows[:40] + [(None, None, "a"), (None, "", "b"), (7, " \n", "a")] * 300
    docs = make_docs(*rows)
    with no_broadcasts(spark):
        out = mixing.mixed_documents(docs)
        moved = _moved(out)
        # All rows with words once, and those that repeat, to be numbered.
        assert sorted(moved)[-1] == 3040 and sum(moved) <= 3040 + 80 + 0.05 * 3000
        got = out.select("doc_id", "text", "source", F.regexp_count("text", F.lit(WORD)).alias("n")).collect()
    words, cut, whole = Counter(), 0, Counter((i, t) for i, t, _ in rows)
    for r in got:
        words[r.source] += r.n
        cut += (r.doc_id, r.text) not in whole
    seen, pieces = mixing.mix(docs)
    want = {r.n: r.w for r in pieces.groupBy("n").agg(F.sum("words").alias("w")).collect()}
    assert sorted(words.values()) == sorted(want.values()) and cut <= 2
    most = Counter((r.doc_id, r.text) for r in got)
    assert all(most[k] <= 2 * whole[k] for k in most if k in whole)
