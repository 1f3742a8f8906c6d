"""Findings and scores of arriving code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from qscore import constants as K
from qscore.functions import paths, text
from qscore.operators.findings import DEFAULT_DETECTORS, findings
from qscore.operators.scoring import finding_counts, pillar_scores
from qscore.sources.files import exclude, source_files


_FILE = ("repo", "path")


def stream_findings(
    files: DataFrame, detectors=DEFAULT_DETECTORS, exclusions=K.DEFAULT_EXCLUSIONS
) -> DataFrame:
    """Findings of a stream of (repo, path, content): stateless, so the batch operators as they are."""
    return findings(source_files(exclude(files, exclusions)), detectors)


def stream_secret_lines(lines: DataFrame, exclusions=K.DEFAULT_EXCLUSIONS) -> DataFrame:
    """Secrets in a stream of single lines (repo, path, ln, line)."""
    path = F.col("path")
    kept = lines.where(~paths.matches_any(path, exclusions) & paths.is_source(path))
    return kept.where(text.has_secret(F.col("line"))).withColumn(
        "pattern", text.secret_pattern(F.col("line"))
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to Parquet files; the sink's log makes every row appear exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def count_batches(
    arrivals: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    detectors=DEFAULT_DETECTORS,
    exclusions=K.DEFAULT_EXCLUSIONS,
) -> StreamingQuery:
    """Count the findings of each arriving file (repo, path, content), one row per file and batch, files
    without findings included. A batch that is run again after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        kept = source_files(exclude(batch, exclusions))
        counts = finding_counts(findings(kept, detectors, keys=_FILE), _FILE)
        known = kept.select(*_FILE).distinct().join(counts, list(_FILE), "left")
        known.fillna(0).fillna(False).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def accumulated_scores(spark: SparkSession, path: str, dimension: DataFrame) -> DataFrame:
    """Scores of the repos in ``dimension`` from all batches so far: a file counts as it arrived last."""
    rows = spark.read.parquet(path)
    counts = ("n_static", "n_architecture", "has_breach")
    last = rows.groupBy(*_FILE).agg(F.max_by(F.struct(*counts), "batch").alias("_c")).select("repo", "_c.*")
    per_repo = last.groupBy("repo").agg(
        F.sum("n_static").alias("n_static"), F.sum("n_architecture").alias("n_architecture"),
        F.bool_or("has_breach").alias("has_breach"),
    )
    return pillar_scores(dimension.select("repo"), per_repo, ["repo"])
