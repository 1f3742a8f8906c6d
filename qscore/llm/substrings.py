"""Removal of repeated passages of words: seed on winnowed anchors, extend, keep what is long enough.

Documents meet on anchors (see :mod:`qscore.llm.repeats`); anchors whose grams agree are extended both ways
as far as the windows that hold them, and runs of repeated windows are the maximal repeats. Every occurrence
is removed, the first one as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from qscore.llm.common import packed, unpacked
from qscore.llm.repeats import Levels, Tables, covered, lean, marks

WORDS = 35
_GRAM = 20


def _read(text: bytes | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()] if text else [], dtype=np.uint64)


def _key() -> Column:
    """Of a row's doc_id and text: what repeats in one text says nothing about another of the same doc_id."""
    return F.xxhash64("doc_id", "text")


def remove_repeats(docs: DataFrame, words: int = WORDS, gram: int = _GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the text without each word that lies in a run of ``words``
    words that occurs anywhere else too, words one space apart.

    Needs doc_id and text; other columns pass through, but for columns of those three names, which are
    replaced. A null or empty text has no words; a text of fewer than ``words`` words stays. Rows that
    repeat a text remove each other's words. Rows that share a doc_id, and rows without doc_id, are documents
    of their own, each with its own repeats. An empty table gives no rows.
    """
    needed = ("doc_id", "text")
    with lean(docs.sparkSession):
        texts = docs.select(_key().alias("doc"), F.col("text").cast("binary").alias("text"))
        tables = Tables(docs.sparkSession)
        index = Levels(tables, _read, words, gram)
        repeated = tables.write(index.repeated(texts), "repeated-words")
        found = tables.write(marks(texts, tables, _read, words, gram, repeated, earlier=False), "word-marks")
        tables.drop("repeat-hits")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, pos: pd.Series, mask: pd.Series) -> pd.DataFrame:
        rows = []
        for text, p, m in zip(texts, pos, mask):
            tokens = text.split() if text else []
            gone = covered(len(tokens), p, m, words)
            kept = [w for w, g in zip(tokens, gone.tolist()) if not g] if gone.any() else tokens
            rows.append((len(tokens), int(gone.sum()), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    rows = packed(docs, needed)
    joined = rows.withColumn("_key", _key()).join(found, F.col("_key") == found["doc"], "left").withColumn(
        "_cut", cut(F.col("text").cast("binary"), "marks.pos", "marks.mask")
    )
    return joined.select(*unpacked(docs.columns, needed, ("n_words", "n_removed", "kept")), "_cut.*")
