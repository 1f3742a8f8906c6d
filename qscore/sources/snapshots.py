"""Snapshots kept as tables in buckets of (repo, path), so that two of them meet without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from qscore.shared import fresh_path

_FILE = ("repo", "path")


def write_snapshot(files: DataFrame, name: str, buckets: int, path: str) -> DataFrame:
    """Saves ``files`` (repo, path, content and any other columns) as table ``name`` of the session's catalog, its
    files below ``path``, and reads it back.

    Content is shuffled once, here: each of ``buckets`` files holds the files of some keys in order. Snapshots with
    the same number of buckets are then compared, and their files opened, bucket by bucket. Choose as many as keep
    a bucket within the memory of a task (some 128 MB of content), and the same for all snapshots of a history.
    """
    (
        files.repartition(buckets, *_FILE)
        .write.bucketBy(buckets, *_FILE)
        .sortBy(*_FILE)
        .option("path", path)
        .saveAsTable(name)
    )
    return files.sparkSession.table(name)


def bucketed(files: DataFrame, buckets: int) -> DataFrame:
    """As :func:`write_snapshot`, for one run: below the shared folder, and under no name in the catalog."""
    spark, name = files.sparkSession, f"snapshot_{uuid.uuid4().hex}"
    table = write_snapshot(files, name, buckets, fresh_path(spark, "snapshot"))
    # The table's files stay; what was read of it needs its entry no more.
    table.schema
    spark.sql(f"DROP TABLE {name}")
    return table
