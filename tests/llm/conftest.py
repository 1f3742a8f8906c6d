import pytest

from qscore.llm.common import WORD  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, and columns named like those of the operators."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    docs = make_docs(
        (1, None), (2, ""), (3, " \n\t "), (4, "one word"), (4, "one word"), (None, "no id at all"), (None, None),
        (5, long), (6, long), (7, "a\n" * 500, None), (8, "tie tie tie"), (9, "tie tie tie"),
    )
    names = ("shard", "slot", "size", "doc", "marks", "kept", "n_words", "label", "fp", "_hash", "_size", "k", "words")
    return docs.withColumns({n: F.lit(n) for n in names})
