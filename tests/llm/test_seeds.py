"""Every pattern that the threshold counts has a seed."""

from itertools import combinations

import pytest

from qscore.llm import decontamination


@pytest.mark.parametrize("length,changes", [(12, 1), (12, 2), (13, 2), (14, 2), (15, 3), (16, 2), (16, 3)])
def test_masks_hit_every_pattern_at_the_threshold(length, changes):
    seeds = [
        {p + i for i, m in enumerate(mask) if m == "1"}
        for mask in decontamination.MASKS for p in range(length - len(mask) + 1)
    ]
    assert all(any(s.isdisjoint(gone) for s in seeds) for gone in combinations(range(length), changes))


@pytest.mark.parametrize("length,changes", [(12, 2), (15, 3), (16, 3)])
def test_leaks_with_any_words_changed_are_found(spark, make_docs, length, changes):
    item = [f"i{k}" for k in range(length)]
    docs = []
    for n, gone in enumerate(combinations(range(length), changes)):
        words = ["x" if k in gone else w for k, w in enumerate(item)]
        docs.append((n, " ".join(words if n % 2 else ["before", *words, "after"])))
    docs.append((len(docs), " ".join(["x"] * (changes + 1) + item[changes + 1 :])))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(make_docs(*docs), bench).collect()}
    assert got == set(range(len(docs) - 1))
