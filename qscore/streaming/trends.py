"""Daily scores of arriving reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_daily_scores(reports: DataFrame, key: str = "repo", late: str = "1 day") -> DataFrame:
    """Mean and least total per key and day of (key, ts, total).

    A day is given out once the watermark passes its end; later reports are dropped. The
    state is one row of sums per key and open day.
    """
    exact = F.col("total").cast("decimal(18,6)")
    return (
        reports.withWatermark("ts", late)
        .groupBy(key, F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("_sum"), F.min("total").alias("least"))
        .select(
            key,
            F.to_date("w.start").alias("day"),
            "n",
            F.round(F.col("_sum").cast("double") / F.col("n"), 6).alias("mean"),
            "least",
        )
    )
