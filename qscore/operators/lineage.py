"""The life of lines: when each copy of a line came into a file, when it left, and which version a line that
is there now came with.

Lines have no names, so copies of a line in one file are told apart by number: the k-th copy lives while
the file holds at least k of them. A line that is taken out and put back has two lives, and what stands in the
file belongs to the second. Lines that move within a file live on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from qscore.functions import text
from qscore.operators import findings as fnd
from qscore.operators.changes import _FILE
from qscore.operators.skew import following, hot_groups, join_few, parted, positions, running_sum
from qscore.shared import materialize

_LINE = (*_FILE, "line")
_COPY = (*_LINE, "copy")


def line_events(versions: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """(repo, path, line, version, net, and the columns of ``order``): by how many copies each version of a file changes
    each of its lines.

    ``versions``: (repo, path, order, content), null content for a file that is gone. ``order`` is total within a file;
    versions for which one of its columns is null are left out. ``version`` counts a file's versions from 1. Content is shuffled once,
    to meet its number; a version takes its lines back from the next one, so no two versions meet. ``versions`` are read
    several times, so written ones are best.
    """
    whole = versions.dropna(subset=[*_FILE, *order])
    # A file's content counts by its length, about as many lines as that.
    hot = hot_groups(whole, _FILE, F.coalesce(F.length("content"), F.lit(0)) / 32 + 1)
    if hot is None:
        return _file_events(whole, order)
    cold, few = parted(whole, _FILE, hot)
    return _file_events(cold, order).unionByName(_ranged_events(few, order))


def _file_events(whole: DataFrame, order: Sequence[str]) -> DataFrame:
    """:func:`line_events` of files whose versions may meet in one task: dealt out once, by file."""
    window = Window.partitionBy(*_FILE).orderBy(*order)
    numbered = whole.select(
        *_FILE, *order, "content",
        F.row_number().over(window).cast("long").alias("version"), F.lead(F.struct(*order)).over(window).alias("_next"),
    )
    lines = numbered.where("content is not null").select(
        *_FILE, *order, "version", "_next", F.explode(text.lines_of(F.col("content"))).alias("line")
    )
    here = F.struct("version", F.lit(1).alias("net"), *order)
    after = F.struct((F.col("version") + 1).alias("version"), F.lit(-1).alias("net"), *[F.col("_next")[c].alias(c) for c in order])
    # Nothing comes after the last version.
    both = F.when(F.col("_next").isNull(), F.array(here)).otherwise(F.array(here, after))
    net = lines.select(*_LINE, F.inline(both)).groupBy(*_FILE, "version", "line", *order).agg(F.sum("net").alias("net"))
    return net.where("net <> 0").select(*_FILE, "version", "line", "net", *order)


def _ranged_events(whole: DataFrame, order: Sequence[str]) -> DataFrame:
    """:func:`line_events` of files with very many versions, none of which is held or sorted by one task."""
    numbered = positions(whole.select(F.struct(*_FILE).alias("_file"), *order), "_file", order, "version")
    places = materialize(numbered.select("_file.*", *order, "version"), "versions")
    lines = whole.join(places, [*_FILE, *order]).select(
        *_FILE, "version", F.explode(text.lines_of(F.col("content"))).alias("line")
    )
    here = F.struct(F.col("version").alias("version"), F.lit(1).alias("net"))
    after = F.struct((F.col("version") + 1).alias("version"), F.lit(-1).alias("net"))
    net = lines.select(*_LINE, F.inline(F.array(here, after))).groupBy(*_LINE, "version").agg(F.sum("net").alias("net"))
    # Nothing comes after the last version, so what that would take back finds no place.
    return net.where("net <> 0").join(places, [*_FILE, "version"])


def copy_events(events: DataFrame) -> DataFrame:
    """``events`` of :func:`line_events`, one row per copy that comes (``born``) or goes: column ``copy``, from 1."""
    counted = running_sum(events, _LINE, ("version",), "net", "_after")
    before = F.col("_after") - F.col("net")
    copies = F.sequence(F.least("_after", before) + 1, F.greatest("_after", before))
    return counted.withColumn("copy", F.explode(copies)).withColumn("born", F.col("net") > 0).drop("net", "_after")


def line_intervals(copies: DataFrame) -> DataFrame:
    """(repo, path, line, copy, born, gone): each life of each copy, from the version it came with to the version it
    was gone with; null ``gone`` for what is still there. ``copies``: :func:`copy_events`, best written."""
    # A copy comes and goes by turns.
    lives = following(copies.select(*_COPY, "version", "born"), _COPY, ("version",), ("version",), "_next").where("born")
    return lives.select(*_COPY, F.col("version").alias("born"), F.col("_next.version").alias("gone"))


def living_lines(
    copies: DataFrame, targets: DataFrame | None = None, order: Sequence[str] = ("seq",), key: str = "target"
) -> DataFrame:
    """(repo, path, line, copy, version, and the columns of ``order``): the lines that are there, each with the version that
    its present life began with.

    With ``targets`` (``key``, repo, at) as of each of them, and ``key`` is a column of the result: what happened at
    ``order[0]`` = at or before counts. A repo may have any number of targets, or none. ``copies``: :func:`copy_events`.
    """
    # A copy comes and goes by turns, so its life at a time began before that and has no end, or a later one.
    lives = following(copies.select(*_COPY, "version", *order, "born"), _COPY, ("version",), (order[0],), "_next").where("born")
    if targets is None:
        return lives.where("_next is null").select(*_COPY, "version", *order)
    asked = targets.groupBy(key, "repo").agg(F.max("at").alias("at"))
    sizes = copies.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    found = join_few(lives, asked, "repo", spread=("path", "line"), sizes=sizes)
    there = (F.col(order[0]) <= F.col("at")) & (F.col("_next").isNull() | (F.col("_next")[order[0]] > F.col("at")))
    return found.where(there).select(key, *_COPY, "version", *order)


@F.pandas_udf(ArrayType(IntegerType()))
def _copy_numbers(lines: pd.Series, places: pd.Series) -> pd.Series:
    """How often the line at each place (from 1) stands in the file up to there."""
    out = []
    for file, asked in zip(lines, places):
        seen: Counter[str] = Counter()
        number = {}
        wanted = set(asked)
        for at, line in enumerate(file, 1):
            seen[line] += 1
            if at in wanted:
                number[at] = seen[line]
        out.append([number[at] for at in asked])
    return pd.Series(out, dtype=object)


def living_attribution(
    files: DataFrame, living: DataFrame, order: Sequence[str] = ("seq",), detectors=fnd.DEFAULT_DETECTORS
) -> DataFrame:
    """(repo, path, pillar, line_start, and the columns of ``order``): findings of ``files`` with the version that the
    present life of their first line began with; nulls where ``living`` does not know the line.

    Unlike :func:`qscore.operators.changes.attribution`, which credits the first commit ever to add a line, one that was
    taken out and put back is the later commit's. ``living``: :func:`living_lines` as of the versions in ``files``.
    """
    path, content = F.col("path"), F.col("content")

    def with_found(lines):
        found = F.concat(*[d(path, content, lines) for d in detectors])
        places = F.transform(found, lambda f: F.struct(f["pillar"].alias("pillar"), f["line_start"].alias("line_start")))
        return F.struct(lines.alias("lines"), places.alias("found"))

    # Only files with findings go on to Python.
    held = files.select(*_FILE, text.once(_f=text.bind(text.lines_of(content), with_found))).where(F.size("_f.found") > 0)
    numbered = held.withColumn("_copies", _copy_numbers("_f.lines", "_f.found.line_start"))
    found = numbered.select(*_FILE, "_f.lines", F.inline(F.arrays_zip(F.col("_f.found").alias("f"), F.col("_copies").alias("copy"))))
    rows = found.select(*_FILE, "f.*", "copy", F.get("lines", F.col("f.line_start") - 1).alias("line"))
    return rows.join(living.select(*_COPY, *order), list(_COPY), "left").select(*_FILE, "pillar", "line_start", *order)
