"""Packing against plain best-fit, and its pieces put together again."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qscore.llm import packing, tokens
from qscore.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else window) - n)
    return sorted(left)


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_windows_are_those_of_plain_best_fit(window):
    rng = random.Random(window)
    for _ in range(30):
        lengths = [rng.randint(1, window) for _ in range(rng.randrange(120))]
        windows = packing.best_fit([(i, 0, n) for i, n in enumerate(lengths)], window)
        assert sorted(window - sum(p[2] for p in w) for w in windows) == plain_best_fit(lengths, window)
        assert sorted(p[0] for w in windows for p in w) == list(range(len(lengths)))


def test_gaps_are_filled_up():
    rng = random.Random(3)
    for share in (0, 0.005, 0.1):
        pieces = [(i, 5, rng.randint(1100, 1300)) for i in range(400)]
        windows = packing.filled_up(packing.best_fit(pieces, 2048), 2048, share)
        total = sum(p[2] for p in pieces)
        assert all(0 < sum(p[2] for p in w) <= 2048 for w in windows)
        assert len(windows) * 2048 <= max(total * (1 + share), total + 2047)
        ends = {}
        for i, start, n in sorted(p for w in windows for p in w):
            assert n > 0 and start == ends.get(i, 5)
            ends[i] = start + n
        assert ends == {i: s + n for i, s, n in pieces}


TEXTS = [
    "", None, " ", "  two  blanks ", "a\n\n b\t\tc \r\n", "it's we'll I'd", "x" * 5000, "\x1c!\x1d? \x85 \xa0   　a", "été naïve 東京 👩‍👩‍👧 е́",
    "<|endoftext|> in <|endoftext|>text", " " * 3000, "1234 5,678.90 !!! ...", "﻿​zero", "a\xa0 \n b  c \tx", "\x00 \x0b\x0c .",
]


def test_ids_are_those_of_whole_texts():
    encoder = tokens.Encoder(TOKENIZER.to_str())
    assert encoder.by_part
    rng = random.Random(8)
    pool = ["a", "word", "Été", " ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "!", "'s", "9", "<|endoftext|>", "é", "　", "."]
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text), text
    given = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    for (text,), ids in zip(given, encoder.ids([t for t, in given]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text), text
    other = public_tokenizers.path("word_bpe_49k.json")
    whole, plain = tokens.Encoder(open(other).read()), Tokenizer.from_file(other)
    assert not whole.by_part and np.frombuffer(next(whole.ids(["Some words  here"])), "<u4").tolist() == plain.encode("Some words  here", add_special_tokens=False).ids


def test_what_is_held_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_HELD", 4000)
    encoder = tokens.Encoder(TOKENIZER.to_str())
    for i in range(100):
        text = " ".join(f"w{i}x{k}" for k in range(30))
        assert np.frombuffer(next(encoder.ids([text])), "<u4").tolist() == plain_ids(text)
        assert encoder.held <= 4000


def check(pieces, docs, window=2048):
    """Every id of every document once, sequences gapless; the share of padding."""
    whole, fill = {}, {}
    for r in pieces:
        assert r.length > 0
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, text in docs:
        ids = np.array(plain_ids(text) + [1], "<u4").tobytes()
        want.setdefault((i, len(ids) // 4), []).append(ids)
    assert whole.keys() == want.keys()
    for key, texts in want.items():
        parts = sorted(whole[key])
        if len(texts) == 1:
            ends = [s + n for s, n, _ in parts]
            assert [s for s, _, _ in parts] == [0, *ends[:-1]] and b"".join(b for *_, b in parts) == texts[0]
        assert sum(n for _, n, _ in parts) == key[1] * len(texts)
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= window
    total = sum(n for places in fill.values() for _, n in places)
    return 1 - total / (window * len(fill))


@pytest.mark.parametrize("group", [50, 8192])
def test_pieces_make_up_the_documents(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(packing, "_GROUP", group)
    rng = random.Random(group)
    rows = list(enumerate(TEXTS))
    rows += [(100 + i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.choice([5, 60, 300, 420, 900, 6000])))) for i in range(120)]
    pieces = packing.pack(make_docs(*rows).repartition(5), PATH).collect()
    whole = sum(r.length for r in pieces)
    assert check(pieces, rows) < 0.005 + 2048 * 5 * (1 if group == 8192 else 2) / whole  # a window at the end of each group
    small = packing.pack(make_docs(*rows), PATH, window=16).collect()
    assert check(small, rows, 16) < 0.01


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = packing.pack(odd_docs, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), rows)
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0
    alone = packing.pack(odd_docs.where("doc_id = 1"), PATH).first()
    assert (alone.start, alone.length, bytes(alone.ids), alone.doc_tokens, alone.offset) == (0, 1, b"\1\0\0\0", 1, 0)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op13_best_fit"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {i: np.array(plain_ids(t) + [1], "<u4") for i, t in texts.items()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    sequences = len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) > 0.98 * 2048 * sequences
    assert QUERIES["op13_best_fit"](spark, folder).where(F.col("length") > 2048).count() == 0
