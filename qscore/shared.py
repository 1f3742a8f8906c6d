"""The folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session; a temporary one, once per process, only where the session names none
    and all tasks run on this machine.

    What is written below it stays until the folder is cleared, so that results can be read lazily:
    remove ``<folder>/qscore`` when a run is over. On a cluster the folder must be one that all executors
    reach, such as a mounted or a distributed file system; this cannot be told from its name.
    """
    folder = spark.conf.get(_SETTING, None) or _temporary.get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="qscore-")
    _temporary[_SETTING] = folder
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/qscore/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
