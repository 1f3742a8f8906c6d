"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the JVM and is then timed in full, all rows written to
the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = (
    "repo_scores",
    "all_findings",
    "gate_with_findings",
    "changeset_scores",
    "changed_lines",
    "scrub_secrets",
    "nesting_depth",
    "duplicate_blocks",
    "structural_duplicates",
    "near_duplicates",
    "pack_payload",
    "review_requests",
    "enhanced_scores",
    "finding_rollup",
    "score_trend",
    "report_markdown",
)


def on_written_files(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Scores of all files, and of a change of ten files, on a table of files rather than on derived ones."""
    from pyspark.sql import functions as F

    from qscore.operators import changes, findings, scoring
    from qscore.plans import corpus
    from qscore.shared import materialize
    from qscore.sources.files import source_files

    files = materialize(corpus.files(spark, sf_dir), "bench-files")
    repos = materialize(corpus.repos(spark, sf_dir), "bench-repos")
    ten = materialize(
        source_files(files).orderBy("repo", "path").limit(10).select(F.lit(1).alias("changeset"), "repo", "path"), "bench-ten"
    )
    runs = {
        "repo_scores_on_files": lambda: scoring.score(findings.findings(source_files(files)), repos),
        "ten_files_of_all": lambda: changes.changeset_scores(ten.select("changeset").distinct(), ten, files),
    }
    seconds = {}
    for name, run in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("qscore-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from qscore.plans.queries import QUERIES

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    seconds: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    seconds |= on_written_files(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "lines": lines,
                "scored_lines_per_sec": round(lines / seconds.get("repo_scores", 1)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
