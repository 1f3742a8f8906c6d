"""Decontamination and removal of repeated words and bytes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qscore.llm import decontamination, substrings, suffixes

RNG = random.Random(11)


def prose(n, vocabulary=400, rng=RNG):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, texts with changed words, passages at the edges and inside, a text that repeats itself."""
    passage, other = prose(60), prose(36)
    base = prose(300)
    changed = base.split()
    for i in (50, 51, 140, 290):
        changed[i] = "changed"
    rows = [base, base, " ".join(changed), passage, passage + " tail end", "head " + passage]
    rows += [f"{prose(20)} {passage} {prose(20)}" for _ in range(30)]
    rows += [f"{prose(9)} {other[k:]}" for k in range(0, 40, 7)]
    rows += ["ab" * 400, "a" * 350, "a" * 99, "a" * 100, prose(34), (prose(50) + " ") * 3, "", None, "é" * 120]
    rows += ["same start " + prose(80)] * 2 + [prose(150) for _ in range(20)]
    return dict(enumerate(rows))


def _covered(n, starts, length):
    hit = [False] * n
    for s in starts:
        hit[s : s + length] = [True] * length
    return hit


def test_repeated_words_are_those_of_brute_force(spark, make_docs, texts):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    counts = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substrings.remove_repeats(make_docs(*texts.items())).collect()}
    assert got.keys() == texts.keys()
    for i, w in words.items():
        hit = _covered(len(w), [k for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1], 35)
        kept = b" ".join(x for x, h in zip(w, hit) if not h).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(hit), kept)
    assert sum(r.n_removed for r in got.values()) > 2000


@pytest.mark.parametrize("batches", [1, 3])
def test_earlier_bytes_are_those_of_brute_force(spark, make_docs, texts, batches):
    seen, want = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        starts = []
        for k in range(len(b) - 99):
            starts += [k] if b[k : k + 100] in seen else []
            seen.add(b[k : k + 100])
        hit = _covered(len(b), starts, 100)
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        want[i] = (len(b), sum(hit), spans, bytes(x for x, h in zip(b, hit) if not h))
    found = suffixes.remove_earlier(make_docs(*texts.items()), batches=batches)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()}
    assert got == want


def test_long_documents_go_in_pieces(spark, make_docs, monkeypatch):
    from qscore.llm import repeats

    rng = random.Random(2)
    a, b = prose(60_000, 10**6, rng), prose(40_000, 10**6, rng)
    docs = make_docs((1, a), (2, b + " " + a[150_000:300_000]), (3, a))
    assert len(a) > repeats._PIECE // 2
    got = {r.doc_id: r.n_removed for r in suffixes.remove_earlier(docs).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 150_000, 3: len(a)}


def test_odd_rows(spark, odd_docs):
    for operator, made in (
        (substrings.remove_repeats, ("n_words", "n_removed", "kept")),
        (suffixes.remove_earlier, ("n_bytes", "n_removed", "n_spans", "kept")),
    ):
        out = operator(odd_docs)
        assert out.columns == [c for c in odd_docs.columns if c not in made] + list(made)
        assert out.count() == odd_docs.count()
        assert {r[0] for r in out.select("shard").distinct().collect()} == {"shard"}
        assert operator(odd_docs.limit(0)).count() == 0
    bytes_left = {r.doc_id: r.n_removed for r in suffixes.remove_earlier(odd_docs).where("doc_id in (5, 6)").collect()}
    assert bytes_left[5] == 0 and bytes_left[6] > 100_000
    assert suffixes.remove_earlier(odd_docs).where("doc_id = 4").agg(F.sum("n_removed")).first()[0] == 0


def _plain_contaminated(text, items, stretch=16, equal=13):
    """Whether any laying of an item on the text has enough equal words in a row."""
    import re

    doc = re.findall(r"[^\W_]+", (text or "").lower())
    for item in items:
        it = re.findall(r"[^\W_]+", (item or "").lower())
        n = len(it)
        if n < 6:
            if n and doc == it:
                return True
            continue
        run = min(stretch, n)
        need = equal if n >= stretch else -(-n * 4 // 5) if n >= 12 else n
        for d in range(-n + 1, len(doc)):
            same = [0 <= d + k < len(doc) and doc[d + k] == w for k, w in enumerate(it)]
            if any(sum(same[s : s + run]) >= need for s in range(n - run + 1)):
                return True
    return False


def test_contamination_is_that_of_brute_force(spark, make_docs):
    rng = random.Random(4)
    items = [prose(n, 10**6, rng) for n in (40, 30, 16, 13, 12, 11)] + [None, "", "short"]
    broken = items[0].split()
    for k in range(3, 40, 9):
        broken[k] = "other"
    worn = [w if k % 3 else "x" for k, w in enumerate(items[0].split())]
    docs = {
        1: f"{prose(50, 10**6, rng)} {items[0]} {prose(50, 10**6, rng)}", 2: " ".join(broken), 3: " ".join(worn),
        4: items[2].upper(), 5: f"x {items[3]} y", 6: items[4], 7: items[5], 8: None, 9: "", 10: prose(500, 10**6, rng),
        11: " ".join(items[1].split()[:14]), 12: " ".join(items[1].split()[:12]), 13: items[1].replace(" ", ", "),
    }
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontamination.contaminated(make_docs(*docs.items()), bench).collect()}
    assert got.keys() == {i for i, t in docs.items() if _plain_contaminated(t, items)}
    assert got[1] == got[2] == 0 and got[4] == 2 and 3 not in got and got[7] == 5
    clean = decontamination.decontaminate(make_docs(*docs.items()), bench)
    assert {r.doc_id for r in clean.collect()} == docs.keys() - got.keys()


@pytest.mark.parametrize("few", [10**6, 0])
def test_items_of_any_length(spark, make_docs, monkeypatch, few):
    """Items of 1 to 40 words: whole, inside a text, with words changed up to the threshold and beyond it."""
    monkeypatch.setattr(decontamination, "_FEW", few)
    rng = random.Random(9)
    items, texts = [], []
    for n in range(1, 41):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append(" ".join(words))
        texts += [" ".join(words), " ".join(words).upper(), "before " + " ".join(words) + " after it", " ".join(words[:-1]), " ".join(words[1:])]
        for changes in (1, 2, 3, 4):
            worn = list(words)
            for k in rng.sample(range(n), min(n, changes)):
                worn[k] = "other"
            texts += [" ".join(worn), "x y " + " ".join(worn) + " z"]
    docs = dict(enumerate(texts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(make_docs(*docs.items()), bench).collect()}
    assert got == {i for i, t in docs.items() if _plain_contaminated(t, items)}
    assert len(got) > 150


def test_a_passage_that_many_items_and_documents_share(spark, make_docs, monkeypatch):
    from qscore.operators import skew

    monkeypatch.setattr(skew, "_MIN_ROWS", 20)
    rng = random.Random(10)
    passage = prose(30, 10**6, rng)
    items = [f"{prose(9, 10**6, rng)} {passage} {prose(9, 10**6, rng)}" for _ in range(60)]
    docs = {i: f"{prose(20, 10**6, rng)} {passage if i % 3 else prose(30, 10**6, rng)} {prose(20, 10**6, rng)}" for i in range(300)}
    docs |= {1000 + i: docs[1] for i in range(200)} | {2000: items[7]}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontamination.contaminated(make_docs(*docs.items()), bench).collect()}
    assert got.keys() == {i for i in docs if i >= 1000 or i % 3}
    assert got[2000] == 7 and {got[1000 + i] for i in range(200)} == {got[1]}


def test_decontamination_of_odd_rows(spark, odd_docs, make_docs):
    item = prose(20)
    bench = spark.createDataFrame([(1, item), (2, item), (3, None)], "item_id long, text string")
    more = odd_docs.unionByName(make_docs((None, item), (20, item), (20, item)), allowMissingColumns=True)
    out = decontamination.decontaminate(more, bench)
    assert out.columns == more.columns and out.count() == odd_docs.count()
    assert decontamination.decontaminate(odd_docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(more, bench.limit(0)).count() == 0
    assert {r.item_id for r in decontamination.contaminated(more, bench).collect()} == {1}


def test_digest_of_kept_words(spark, make_docs):
    out = substrings.remove_repeats(make_docs((1, "a  b\nc"))).select(F.sha2(F.col("kept").cast("binary"), 256)).first()
    assert out[0] == hashlib.sha256(b"a b c").hexdigest()
