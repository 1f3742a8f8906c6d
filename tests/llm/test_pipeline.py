"""The stages in a row, held against plain versions, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from qscore.llm.queries import QUERIES
from tests.llm.test_mixing_sharding import check_shards, plain_targets
from tests.llm.test_removal import _plain_contaminated
from tests.llm.test_similar import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def tables(spark, make_docs, tmp_path_factory):
    rng = random.Random(21)

    def words(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    item = " ".join(words(30))
    rows = []
    for i in range(240):
        text = words(rng.choice([40, 120, 300]))
        if i % 4 == 1:
            text[5:5] = ["you", "utter", "idiot", "and", "moron"]
        if i % 16 == 2:
            text[20:20] = item.split()
        rows.append((i, " ".join(text), rng.choice(["a", "a", "a", "b", None])))
        if i % 10 == 6:
            rows.append((1000 + i, rows[-1][1], "b"))
            text[7] = "changed"
            rows.append((2000 + i, " ".join(text), "a"))
    rows += [(5000, None), (5001, ""), (None, "no id"), (6, rows[6][1], rows[6][2])]
    folder = str(tmp_path_factory.mktemp("tables"))
    names = ("toxicity", "shard", "fp", "text_hash", "label", "_id", "n", "component_id")
    docs = make_docs(*rows).withColumns({n: F.lit(n) for n in names})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item, rows


def test_stages_do_what_plain_versions_do(spark, tables):
    folder, item, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], folder).cache())
    _, calm, unique, clean, mixed, sharded = outs
    for out in outs[1:5]:
        assert set(out.columns) == set(docs.columns)

    kept = {r.doc_id for r in calm.collect()}
    assert not any(i is not None and i % 4 == 1 and i < 1000 for i in kept)
    assert kept == {r[0] for r in rows if "idiot" not in (r[1] or "")}

    texts = {r.doc_id: r.text for r in calm.where("doc_id is not null").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    label = plain_components(texts, near)
    assert {r.doc_id for r in unique.collect()} == {None} | {i for i in texts if label[i] == i}

    left = {r.doc_id: r.text for r in unique.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, t in left.items() if not _plain_contaminated(t, [item])}

    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in plain_targets(sizes).items())

    assert sharded.count() == mixed.count()
    check_shards(sharded, corpus_pipeline.SHARDS)


def test_run(spark, tables, tmp_path):
    folder, _, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "shard", "slot", "size"} <= set(out.columns) and out.count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(QUERIES) <= names


def test_given_documents_lose_no_clean_one(spark):
    """On the smallest given tables, what the first three stages drop is toxic, a copy or a leak."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, folder)
    assert docs.count() * 0.7 < out.count() < docs.count()
