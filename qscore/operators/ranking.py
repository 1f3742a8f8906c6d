"""Order of findings, top findings, score trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from qscore import constants as K
from qscore.operators.skew import positions, trailing_window


def rank(priority: Column) -> Column:
    """0 for CRITICAL to 3 for LOW, 4 for anything else; case does not matter."""
    return F.coalesce(
        *[F.when(F.upper(priority) == p, i) for i, p in enumerate(K.PRIORITIES)],
        F.lit(len(K.PRIORITIES)),
    )


def label(priority: Column) -> Column:
    """Known priorities in upper case, others as they are."""
    return F.when(F.upper(priority).isin(*K.PRIORITIES), F.upper(priority)).otherwise(priority)


def ranked(findings: DataFrame, key: str = "repo", ties: tuple[str, ...] = ("location",)) -> DataFrame:
    """Findings with their position by rank within a key; ``ties`` make the order total.

    Sorted over ranges of the whole order, so that a key with very many findings is spread
    over many sorted partitions.
    """
    rows = findings.withColumn("rank", rank(F.col("priority"))).withColumn("label", label(F.col("priority")))
    return positions(rows, key, ("rank", *ties))


def top_findings(
    findings: DataFrame, n: int = 3, key: str = "repo", ties: tuple[str, ...] = ("location",)
) -> DataFrame:
    """The ``n`` first findings of each key; tasks keep only ``n`` per key before the shuffle."""
    order = Window.partitionBy(key).orderBy("rank", *ties)
    return (
        findings.withColumn("rank", rank(F.col("priority")))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
    )


def score_trend(history: DataFrame, key: str = "repo", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Previous total, change and mean of the last seven totals, per report of a key.

    Totals are multiples of a half, so decimal sums are exact.
    """
    exact = F.col("total").cast("decimal(18,6)")
    measures = {
        "previous": lambda w: F.lag("total").over(w),
        "_sum": lambda w: F.sum(exact).over(w.rowsBetween(-6, 0)),
        "_n": lambda w: F.count(exact).over(w.rowsBetween(-6, 0)),
    }
    out = trailing_window(history, key, order, depth=6, measures=measures)
    return out.select(
        *history.columns,
        "previous",
        (F.col("total") - F.col("previous")).alias("delta"),
        F.round(F.col("_sum").cast("double") / F.col("_n"), 6).alias("moving_mean"),
    )


def daily_scores(history: DataFrame, key: str = "repo") -> DataFrame:
    """Mean and least total per key and day."""
    exact = F.col("total").cast("decimal(18,6)")
    return history.groupBy(key, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(exact).alias("_sum"),
        F.min("total").alias("least"),
    ).select(key, "day", "n", F.round(F.col("_sum").cast("double") / F.col("n"), 6).alias("mean"), "least")
