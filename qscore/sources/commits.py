"""Commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qscore.functions.text import trim_space
from qscore.operators.skew import join_few

_LOG_LINE = r"^([0-9a-f]+) (.+)$"


def commits(log: DataFrame) -> DataFrame:
    """(repo, seq, hash, message) from (repo, seq, log_line); other lines are dropped.

    A line reads ``<hex> <subject>``; one without a subject is no commit.
    """
    line = trim_space(F.col("log_line"))
    return log.where(line.rlike(_LOG_LINE)).select(
        "repo",
        "seq",
        F.regexp_extract(line, _LOG_LINE, 1).alias("hash"),
        F.regexp_extract(line, _LOG_LINE, 2).alias("message"),
    )


def commits_in_range(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Commits after ``from_seq`` up to ``to_seq``; ``ranges`` has (repo, from_seq, to_seq) and
    may have a ``range`` that names them; then a commit is given once per range that holds it.

    A repo with most of the log is spread over many tasks.
    """
    found = join_few(commits(log), ranges, "repo", spread=("seq",))
    named = ["range"] if "range" in ranges.columns else []
    return found.where((F.col("seq") > F.col("from_seq")) & (F.col("seq") <= F.col("to_seq"))).select(
        *named, "repo", "seq", "hash", "message"
    )
