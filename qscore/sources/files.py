"""File snapshots: scan, exclude, keep source files."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from qscore import constants as K
from qscore.functions import paths
from qscore.operators.skew import join_few
from qscore.sources.policies import exclusion_patterns

# "file:/a", "file:///a" and "scheme://host/a" all become absolute paths.
_SCHEME = re.compile("^[A-Za-z0-9]+:/*")


def scan(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Regular files below ``root``: (repo, path, size, raw), paths relative to it.

    ``raw`` (the bytes) is read only where a later step uses it, and only for the files
    that later filters on ``path`` keep.
    """
    top = _SCHEME.sub("/", root).rstrip("/")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    relative = paths.relative(F.regexp_replace("path", _SCHEME.pattern, "/"), top)
    return found.select(
        F.lit(repo or top).alias("repo"),
        relative.alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("raw"),
    )


def read_files(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    exclusions: Sequence[str] = K.DEFAULT_EXCLUSIONS,
) -> DataFrame:
    """Snapshot of the source files below ``root``: (repo, path, content)."""
    kept = source_files(exclude(scan(spark, root, repo), exclusions))
    return kept.select("repo", "path", F.col("raw").cast("string").alias("content"))


def exclude(
    files: DataFrame, patterns: Sequence[str] = K.DEFAULT_EXCLUSIONS
) -> DataFrame:
    """Rows whose path no glob matches. A filter on ``path`` alone: content is not read for it."""
    return files.where(~paths.matches_any(F.col("path"), patterns))


def exclude_by_policy(
    rows: DataFrame, rules: DataFrame, key: str = "repo", path: str = "path"
) -> DataFrame:
    """As :func:`exclude`, with ``rules`` (key, regex) from :func:`policy_regexes`.

    Keys without a rule exclude nothing. ``rows`` may be files or findings (``path`` is
    then their location): prefer findings, which are small, as the join may move its
    rows. Rows of a key that has very many are spread by path.
    """
    numbered, excluded = _by_rule(rules, "regex")
    ruled = join_few(rows, numbered.select(key, "_rule"), key, (path,), "left")
    return ruled.where(~F.coalesce(excluded(F.col(path)), F.lit(False))).select(*rows.columns)


# Distinct patterns that become expressions of the plan at most.
_FEW_RULES = 100


def _by_rule(rules: DataFrame, column: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``rules`` with ``_rule``, and whether a path matches the rule of its row.

    Owners share few distinct patterns: up to 100 are numbered, and each is compiled once. Were there more, the
    pattern itself would be ``_rule``, compiled for each row, with the same result.
    """
    found = rules.select(column).where(F.col(column).isNotNull()).distinct().limit(_FEW_RULES + 1).collect()
    if len(found) > _FEW_RULES:
        return rules.withColumn("_rule", F.col(column)), lambda path: F.rlike(path, F.col("_rule"))
    known = sorted(r[0] for r in found)

    def matches(path: Column) -> Column:
        hit = F.lit(None).cast("boolean")
        for i, regex in enumerate(known):
            hit = F.when(F.col("_rule") == i, path.rlike(regex)).otherwise(hit)
        return hit

    number = F.lit(None).cast("int")
    for i, regex in enumerate(known):
        number = F.when(F.col(column) == regex, i).otherwise(number)
    return rules.withColumn("_rule", number), matches


@F.pandas_udf(StringType())
def _compiled(pattern: pd.Series) -> pd.Series:
    return pattern.map(paths.glob_regex)


def policy_regexes(patterns: DataFrame, key: str = "repo") -> DataFrame:
    """(key, regex) from rows (key, pattern): the globs of a key as one regular expression.

    Only pattern rows pass through Python, never files.
    """
    return (
        patterns.select(key, _compiled("pattern").alias("rx"))
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_set("rx")), "|").alias("regex"))
    )


def exclusion_rules(repos: DataFrame, policies: DataFrame, on: str = "org", key: str = "repo") -> DataFrame:
    """(repo, regex): what the policy of a repo's owner excludes. ``repos``: (repo, ``on``); ``key`` names another key."""
    rules = policy_regexes(exclusion_patterns(policies, on), key=on)
    return repos.select(key, on).join(rules, on).select(key, "regex")


def unmatched_exclusions(
    files: DataFrame, patterns: Sequence[str], keys: Sequence[str] = ("repo",), dimension: DataFrame | None = None
) -> DataFrame:
    """One row per key and glob that matched no file of that key, with the warning text.

    One pass over the paths with a flag per glob; flags combine before the shuffle. Keys of
    ``dimension`` without any file have no match either; without it, keys are those of the files.
    """
    flags = [
        F.max(paths.matches_any(F.col("path"), [p])).alias(f"_m{i}")
        for i, p in enumerate(patterns)
    ]
    hits = F.array(
        *[
            F.struct(F.lit(p).alias("pattern"), F.col(f"_m{i}").alias("hit"))
            for i, p in enumerate(patterns)
        ]
    )
    flagged = files.groupBy(*keys).agg(*flags)
    if dimension is not None:
        flagged = dimension.select(*keys).join(flagged, list(keys), "left")
    return (
        flagged
        .select(*keys, F.inline(hits))
        .where(~F.coalesce("hit", F.lit(False)))
        .select(
            *keys,
            "pattern",
            F.concat(F.lit(K.UNMATCHED_PATTERN_TEXT), "pattern").alias("warning"),
        )
    )


def unmatched_by_policy(files: DataFrame, owners: DataFrame, patterns: DataFrame, on: str = "org") -> DataFrame:
    """As :func:`unmatched_exclusions`, with the globs of each repo's own policy.

    ``owners``: (repo, ``on``), every repo; ``patterns``: (``on``, pattern). A malformed glob matches
    nothing. Paths are matched once per glob of their repo, and matches are counted before the shuffle.
    """
    compiled = patterns.select(on, "pattern", _compiled("pattern").alias("_rx")).distinct()
    numbered, hit = _by_rule(compiled, "_rx")
    wanted = owners.select("repo", on).join(numbered, on).select("repo", "pattern", "_rule")
    owned = join_few(files.select("repo", "path"), wanted, "repo", ("path",))
    matched = owned.where(hit(F.col("path"))).select("repo", "pattern").distinct()
    return (
        wanted.join(matched, ["repo", "pattern"], "left_anti")
        .select("repo", "pattern", F.concat(F.lit(K.UNMATCHED_PATTERN_TEXT), "pattern").alias("warning"))
    )


def source_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_source(F.col("path")))


def path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        "repo",
        "path",
        paths.base_name(path).alias("base"),
        paths.extension(path).alias("ext"),
        paths.is_source(path).alias("is_source"),
        paths.is_non_code(path).alias("is_non_code"),
    )


def in_walk_order(files: DataFrame, *keys: str | Column) -> DataFrame:
    """Files sorted as a directory walk meets them (range-partitioned: a hot key is split)."""
    return files.orderBy(*keys, paths.walk_order(F.col("path")))
