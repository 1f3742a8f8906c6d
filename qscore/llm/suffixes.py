"""Removal of byte strings that start earlier: sparse suffix arrays in a logarithmic family of levels.

A suffix array over every byte takes many times the space of the text. Here only the suffixes that begin at
winnowed anchors are kept (see :mod:`qscore.llm.repeats`), sorted and merged by a hash of the gram they begin
with: equal strings of ``length`` bytes choose anchors at equal places, so no long match is lost. A batch of
documents is merged into the levels before it as soon as they hold as many batches; the last batch is
scanned against all levels, and long matches are extended around the suffixes whose beginnings agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from qscore.llm.common import packed, unpacked
from qscore.llm.repeats import Levels, Tables, covered, lean, marks
from qscore.operators.skew import positions
from qscore.shared import materialize

LENGTH = 100
_GRAM = 38
_SMALLEST = -(1 << 63)
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


def _read(text: bytes | None) -> np.ndarray:
    return _BYTES[np.frombuffer(text or b"", np.uint8)]


def numbered(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """``docs``, packed, with ``_doc``: a number for each doc_id and text, in the order of doc_id (null first) and then
    of a hash of the text. It is the doc_id itself where no two texts share one, which is looked up first."""
    rows, hashed = packed(docs, needed), F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.coalesce("doc_id", F.lit(_SMALLEST)).cast("long")
    keys = docs.select("doc_id", own.alias("_doc"), hashed.alias("_hash"))
    spans = keys.groupBy("_doc").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b"))
    if not spans.where("a != b").select("_doc").take(1):
        return rows.withColumn("_doc", own)
    keys = materialize(keys.select("doc_id", "_hash").distinct().withColumn("_all", F.lit(0)), "suffix-keys")
    numbers = positions(keys, "_all", ["doc_id", "_hash"], "_doc").select(F.col("doc_id").alias("_id"), "_hash", "_doc")
    same = rows["doc_id"].eqNullSafe(numbers["_id"]) & (hashed == numbers["_hash"])
    return materialize(rows.join(numbers, same).drop("_id", "_hash"), "suffix-rows")


def remove_earlier(docs: DataFrame, length: int = LENGTH, gram: int = _GRAM, batches: int = 2) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary): the text as UTF-8 without each byte that
    lies in a string of ``length`` bytes that also starts earlier, in a smaller doc_id or further ahead in
    the same text. Spans are maximal runs of removed bytes.

    Needs doc_id and text; other columns pass through, but for columns of those four names, which are
    replaced. A null text is empty; a text shorter than ``length`` stays. A null doc_id is the smallest.
    Of rows that repeat doc_id and text neither is earlier, so both stay. Rows that share a doc_id but not the text
    (rows without doc_id among them) are documents of their own, the earlier one by a hash of the text. An empty
    table gives no rows. ``batches`` parts by doc_id are indexed one after the other.
    """
    needed = ("doc_id", "text")
    with lean(docs.sparkSession):
        rows = numbered(docs, needed)
        texts = rows.select(F.col("_doc").alias("doc"), F.col("text").cast("binary").alias("text"))
        parts = [i / batches for i in range(1, batches)]
        cuts = texts.agg(F.percentile_approx("doc", F.lit(parts), 1000)).first()[0] or [0] * len(parts) if parts else []
        bounds = [None, *cuts, None]
        tables = Tables(docs.sparkSession)
        index = Levels(tables, _read, length, gram)
        for low, high in zip(bounds, bounds[1:]):
            batch = texts if low is None else texts.where(F.col("doc") > low)
            batch = batch if high is None else batch.where(F.col("doc") <= high)
            if high is not None:
                index.add(batch)
        repeated = tables.write(index.repeated(batch), "repeated-bytes")
        for _, name, _ in index.levels:
            tables.drop(name)
        found = tables.write(marks(texts, tables, _read, length, gram, repeated, earlier=True), "byte-marks")
        tables.drop("repeat-hits")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, pos: pd.Series, mask: pd.Series) -> pd.DataFrame:
        rows = []
        for text, p, m in zip(texts, pos, mask):
            text = text or b""
            gone = covered(len(text), p, m, length)
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            rows.append((len(text), int(gone.sum()), spans, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(found, rows["_doc"] == found["doc"], "left").withColumn("_cut", cut(F.col("text").cast("binary"), "marks.pos", "marks.mask"))
    return joined.select(*unpacked(docs.columns, needed, ("n_bytes", "n_removed", "n_spans", "kept")), "_cut.*")
