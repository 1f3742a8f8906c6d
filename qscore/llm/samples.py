"""A bounded, repeatable sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qscore.llm.common import hash63


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null doc_id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(text, label) of at most ``most`` documents of each class 0 and 1, chosen by a hash of doc_id.

    ``usable`` is a condition on doc_id. Labels other than 0 and 1, null doc_ids and labels without a
    document are left out; of rows that share a doc_id the one whose text has the least hash is taken. Only the chosen ids, of which there are 2 x ``most`` at most, are broadcast,
    and no text is shuffled but that of the sample.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(hash63("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    # The same row of a shared doc_id in every run, whichever task comes first.
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("first")
    return found.groupBy("doc_id").agg(first).select("doc_id", "first.text", "first.label")
