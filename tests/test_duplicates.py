import random

import pytest
from pyspark.sql import functions as F

from qscore.functions import code
from qscore.operators import duplicates as dup


def _files(spark, contents):
    return spark.createDataFrame([("r", p, c) for p, c in contents.items()], "repo string, path string, content string")


def test_same_body(spark):
    files = _files(
        spark,
        {
            "a.go": "func a() {\n  x := 1\n}\nfunc empty() {",
            "b.go": "func b() {\nx   :=  1\n\n}\nfunc other() {\ny := 1\n}",
            "c.go": "def c():\nx := 1 }\nfunc empty2() {",
        },
    )
    (hit, *rest) = sorted(dup.duplicate_blocks(files).collect())
    assert (hit.path, hit.first_path, hit.first_line, hit.copies) == ("b.go", "a.go", 1, 3)
    assert [r.path for r in rest] == ["c.go"]
    (finding, _) = dup.as_findings(dup.duplicate_blocks(files)).orderBy("location").collect()
    assert finding.description == "Same code as a.go:1"


def test_same_structure(spark):
    files = _files(
        spark,
        {
            "a.go": 'func a() {\nif ok && n1 > 10 { say("hello") }',
            "b.go": "func b() {\nif done && count > 9.5 { log('bye') }",
            "c.go": 'func c() {\nfor ok && n1 > 10 { say("hello") }',
        },
    )
    (hit,) = dup.duplicate_blocks(files, normal=code.structure).collect()
    assert (hit.path, hit.first_path) == ("b.go", "a.go")
    assert dup.duplicate_blocks(files).count() == 0


def _sets(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 5, 0) + 1)}


def test_near_copies_against_all_pairs(spark):
    """Every reported pair is exact, and every text close to an earlier one is reported."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for copy in range(5):
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(len(words))] = "changed"
            texts[group * 5 + copy] = " ".join(words)
    texts[100], texts[101], texts[102] = texts[0], texts[0], "three short words"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = dup.near_duplicates(rows).collect()

    def similarity(a, b):
        x, y = _sets(texts[a]), _sets(texts[b])
        return round(len(x & y) / len(x | y), 6)

    assert all(r.jaccard == similarity(r.doc_id, r.first_doc_id) >= 0.8 for r in got)
    assert all(r.first_doc_id < r.doc_id for r in got)
    close = {a for a in texts for b in texts if b < a and similarity(a, b) >= 0.8}
    assert {r.doc_id for r in got} == close
    assert len(got) == len({(r.doc_id, r.first_doc_id) for r in got})


@pytest.mark.parametrize("block", [1_000, 2])
def test_all_near_pairs_of_templates_and_chains(spark, monkeypatch, block):
    """Texts from one template, chains of edits, and texts of common words only: no pair is lost."""
    monkeypatch.setattr(dup, "_BLOCK", block)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    template = [rng.choice(words) for _ in range(80)]
    made = [" ".join(template + [rng.choice(words) for _ in range(rng.randrange(5, 40))]) for _ in range(60)]
    chain = [rng.choice(words) for _ in range(100)]
    for step in range(60):
        chain[rng.randrange(100)] = f"edit{step}"
        made.append(" ".join(chain))
    made += [" ".join(["to be or not"] * n) for n in range(1, 12)] + ["", " ", "one", "ONE", "a b c d e", "a b c d e f", made[3], made[3]]
    texts = dict(enumerate(made))
    rows = spark.createDataFrame([*texts.items(), (None, made[0]), (500, None)], "doc_id long, text string")
    first = {}
    for i, t in texts.items():
        first.setdefault(t, i)
    sets = {i: _sets(t) if t.strip() else {""} for i, t in texts.items()}
    expected = {(i, first[t], 1.0) for i, t in texts.items() if first[t] != i}
    for a in first.values():
        for b in first.values():
            both = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if b < a and both >= 0.8:
                expected.add((a, b, round(both, 6)))
    got = [tuple(r) for r in dup.near_duplicates(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 200
    assert dup.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text,n", [("", 1), ("one two", 1), ("a b c d e", 1), ("a b c d e f", 2), ("x x x x x x x", 1)])
def test_shingles(spark, text, n):
    row = spark.createDataFrame([(text,)], "t string")
    assert len(row.select(dup.shingles(F.col("t"))).first()[0]) == n


def test_sets_move_only_for_pairs_that_may_be_near(spark, monkeypatch):
    """Texts of one size that share a passage meet, but their whole sets are fetched only where parities allow it."""
    tables = {}
    write = dup.materialize
    monkeypatch.setattr(dup, "materialize", lambda df, label: tables.setdefault(label, write(df, label)))
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(150)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(40)]
    texts += [f"{texts[0]} more", f"{texts[1]} more words"]
    got = dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(40, 0), (41, 1)}
    assert tables["close-candidates"].count() == 2 and tables["close-texts"].count() == 4


def test_common_runs_are_common_at_a_count(spark):
    """Runs in a few of many texts are learnt, too: at a share of them pairs would grow with the square."""
    sets = spark.range(20_000).selectExpr(
        "id AS doc_id", "sha2(cast(id AS string), 256) AS _hash", "array(id + 1000, id div 100) AS _runs"
    )
    common = dup._common_runs(sets, sets.select("doc_id"), 20_000)
    assert set(range(200)) - set(common.tolist()) == set() and len(common) == 200
