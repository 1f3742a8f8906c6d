"""What several operators share: words, written tables, and sums that run through a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash63(*columns: str | Column) -> Column:
    """A hash from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def packed(docs: DataFrame, needed: Sequence[str]) -> DataFrame:
    """The columns that an operator needs, and all others in one, so that no name of theirs meets one of its own."""
    others = [c for c in docs.columns if c.lower() not in needed]
    rest = F.struct(*[docs[f"`{c}`"] for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*needed, rest.alias("__rest"))


def unpacked(columns: Sequence[str], needed: Sequence[str], replaced: Sequence[str] = ()) -> list[Column]:
    """The columns in their old order; those named in ``replaced`` are left to the operator."""
    return [
        F.col(c) if c.lower() in needed else F.col("__rest")[c].alias(c)
        for c in columns
        if c.lower() not in replaced
    ]


def running(rows: DataFrame, key: str, cell: Column, order: list, weight: Column) -> DataFrame:
    """Adds ``_before``: the weight of the rows of a key that stand before a row.

    ``cell`` cuts a key into pieces, in the order of ``order``, so that no task sorts all rows of a
    hot key: each piece is summed up on its own and gets the sum of the pieces before it. ``rows``
    is evaluated twice and must give the same rows both times (a table, or columns of one).
    """
    rows = rows.withColumn("_cell", cell).withColumn("_weight", weight)
    through = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy(key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(key, "_cell")
        .agg(F.sum("_weight").alias("_sum"))
        .select(key, "_cell", F.coalesce(F.sum("_sum").over(through), F.lit(0)).alias("_start"))
    )
    return (
        rows.repartition(key, "_cell")
        .withColumn("_inner", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
        .join(starts, [key, "_cell"])
        .withColumn("_before", F.col("_start") + F.col("_inner"))
        .drop("_cell", "_weight", "_inner", "_start")
    )
