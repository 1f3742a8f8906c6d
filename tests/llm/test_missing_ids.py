"""Texts without doc_id, or with the same one, keep what does not repeat."""

import random

from qscore.llm import substrings, suffixes


def test_words_of_texts_without_id_are_cut_on_their_own(make_docs):
    passage = " ".join(f"p{i}" for i in range(40))
    own = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    docs = make_docs(
        (None, f"{passage} {own['a']}"), (None, own["b"]), (1, passage), (2, f"{passage} tail"), (2, own["c"]),
        *[(None, passage)] * 5,
    )
    got = sorted((r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect())
    assert got == sorted([(40, own["a"]), (0, own["b"]), (40, ""), (40, "tail"), (0, own["c"]), *[(40, "")] * 5])


def test_bytes_of_texts_without_id_are_cut_on_their_own(make_docs):
    rng = random.Random(12)

    def text(n):
        return "".join(rng.choices("abcdefgh", k=n))

    p, a, u, v = text(312), text(500), text(951), text(400)
    rows = [(None, p), (None, a + p), (None, u), (None, None), (7, v), (7, u), (7, p), (-5, a), (-(1 << 63), text(300)), (7, v)]
    got = {(r.doc_id, r.text): r.n_removed for r in suffixes.remove_earlier(make_docs(*rows)).collect()}
    # One of the texts without id has the first occurrence of p; everything else of them is nowhere before.
    assert sorted((got[None, p], got[None, a + p])) == [0, len(p)]
    assert (got[None, u], got[None, None], got[7, v], got[7, u], got[7, p], got[-5, a]) == (0, 0, 0, len(u), len(p), len(a))
    assert got[rows[8]] == 0 and suffixes.remove_earlier(make_docs(*rows)).count() == len(rows)
