"""Findings to pillar scores to totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from qscore import constants as K
from qscore.functions.text import number_text

PILLARS = tuple(K.PILLAR_MAX)


def total() -> Column:
    """Sum of the pillar columns in a fixed order."""
    out = F.col(PILLARS[0])
    for p in PILLARS[1:]:
        out = out + F.col(p)
    return out


def finding_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What pillars and gate need of a key's findings: three counts and a flag.

    Combined before the shuffle: at most one row per key and task moves.
    """
    pillar, severity = F.col("pillar"), F.col("severity")
    return findings.groupBy(*keys).agg(
        F.count_if(pillar == K.STATIC).alias("n_static"),
        F.count_if(pillar == K.ARCHITECTURE).alias("n_architecture"),
        F.bool_or(
            (pillar == K.SECURITY)
            & F.coalesce(severity.isin(*K.BLOCKING_SEVERITIES), F.lit(False))
        ).alias("has_breach"),
        F.count_if(severity.isin(*K.BLOCKING_SEVERITIES)).alias("blocking_findings"),
    )


def pillar_scores(
    dimension: DataFrame, counts: DataFrame, keys: Sequence[str], blocking: bool = False
) -> DataFrame:
    """Pillars and total of every key of ``dimension``; a key without findings scores 100.

    Other columns of ``dimension``, such as the owner of a repo, are kept.
    ``blocking`` adds ``blocking_findings``, the CRITICAL and HIGH findings of any pillar.
    """

    def floor(points: float, count: str, each: float) -> Column:
        return F.greatest(
            F.lit(0.0), F.lit(points) - F.coalesce(F.col(count), F.lit(0)) * F.lit(each)
        )

    top = K.PILLAR_MAX
    return (
        dimension.join(counts, list(keys), "left")
        .select(
            *dimension.columns,
            floor(top[K.STATIC], "n_static", K.STATIC_DEDUCTION).alias(K.STATIC),
            floor(top[K.ARCHITECTURE], "n_architecture", K.ARCHITECTURE_DEDUCTION).alias(
                K.ARCHITECTURE
            ),
            F.lit(top[K.VERIFICATION]).alias(K.VERIFICATION),
            F.when(F.col("has_breach"), 0.0).otherwise(top[K.SECURITY]).alias(K.SECURITY),
            *(
                [F.coalesce("blocking_findings", F.lit(0)).alias("blocking_findings")]
                if blocking
                else []
            ),
        )
        .withColumn("total", total())
    )


def score(
    findings: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str] = ("repo",),
    blocking: bool = False,
) -> DataFrame:
    return pillar_scores(dimension, finding_counts(findings, keys), keys, blocking)


def apply_mutation_penalty(scores: DataFrame, coverage: DataFrame, key: str = "repo") -> DataFrame:
    """Verification x 0.8 where mutation coverage is below the floor; unknown costs nothing.

    ``coverage`` has one row per key: (key, mutation_coverage, mutation_floor). Adds
    ``penalty_message``, null where nothing was taken off.
    """
    low = F.coalesce(F.col("mutation_coverage") < F.col("mutation_floor"), F.lit(False))
    message = F.format_string(
        K.MUTATION_TEXT,
        number_text(F.col("mutation_coverage"), 0),
        number_text(F.col("mutation_floor"), 0),
    )
    return (
        scores.join(coverage, key, "left")
        .withColumn("penalty_message", F.when(low, message))
        .withColumn(
            K.VERIFICATION,
            F.when(low, F.col(K.VERIFICATION) * K.MUTATION_FACTOR).otherwise(
                F.col(K.VERIFICATION)
            ),
        )
        .withColumn("total", total())
    )


def farley_index(suites: DataFrame, key: str = "repo") -> DataFrame:
    """Weighted test-quality index per key (mean over its suites) and the base points.

    Decimals keep the mean independent of the order of addition.
    """
    weighted = None
    for name, weight in K.FARLEY_WEIGHTS.items():
        term = F.col(name).cast("decimal(10,4)") * F.lit(weight).cast("decimal(4,2)")
        weighted = term if weighted is None else weighted + term
    mean = F.sum(weighted).cast("double") / (F.count(weighted) * F.lit(K.FARLEY_DIVISOR))
    return suites.groupBy(key).agg(F.round(mean, 6).alias("farley_index")).withColumn(
        "base_points", F.round(F.col("farley_index") * K.FARLEY_POINTS, 6)
    )


def static_subscores(lint: DataFrame, key: str = "repo") -> DataFrame:
    """Style (5 x share of clean files), linter (10 - 0.5 per warning), dead code (5 or 0).

    ``lint``: one row per file with (key, is_clean, warnings, has_dead_code). The share
    of clean files is our reading of the standard, which only says divergence costs.
    """
    style = 5.0 * F.count_if("is_clean") / F.count(F.lit(1))
    return lint.groupBy(key).agg(
        F.round(style, 6).alias("style"),
        F.greatest(F.lit(0.0), 10.0 - 0.5 * F.sum("warnings")).alias("linter"),
        F.when(F.bool_or("has_dead_code"), 0.0).otherwise(5.0).alias("dead_code"),
    )


def architecture_subscores(functions: DataFrame, key: str = "repo") -> DataFrame:
    """15 x share of functions with complexity <= 10; 10 if the mean depth is <= 3, else 0."""
    n = F.count(F.lit(1))
    simple = F.count_if(F.col("complexity") <= K.MAX_COMPLEXITY)
    return functions.groupBy(key).agg(
        F.round(15.0 * simple / n, 6).alias("cyclomatic"),
        F.when(F.sum("depth") <= K.MAX_NESTING * n, 10.0).otherwise(0.0).alias("cognitive"),
    )


def security_subscores(
    dimension: DataFrame, sast: DataFrame, sca: DataFrame, key: str = "repo"
) -> DataFrame:
    """10 unless a CRITICAL/HIGH scanner hit; 10 unless an open vulnerability."""
    bugs = sast.groupBy(key).agg(
        F.bool_or(F.upper("severity").isin(*K.BLOCKING_SEVERITIES)).alias("_bug")
    )
    holes = sca.groupBy(key).agg(F.bool_or("is_open").alias("_hole"))
    return (
        dimension.join(bugs, key, "left")
        .join(holes, key, "left")
        .select(
            key,
            F.when(F.col("_bug"), 0.0).otherwise(10.0).alias("sast"),
            F.when(F.col("_hole"), 0.0).otherwise(10.0).alias("sca"),
        )
    )


def standard_scores(
    dimension: DataFrame,
    static: DataFrame,
    architecture: DataFrame,
    farley: DataFrame,
    security: DataFrame,
    coverage: DataFrame,
    key: str = "repo",
) -> DataFrame:
    """Pillars and total of the written standard, from the sub-scores above and the test quality.

    Static is style + linter + dead code, architecture cyclomatic + cognitive, verification the base
    points (times 0.8 where ``coverage`` is below its floor), security sast + sca. A sub-score that was
    not measured counts in full, as a repository without findings does. ``coverage``: (key,
    mutation_coverage, mutation_floor).
    """
    out = dimension.select(key)
    for part in (static, architecture, farley.drop("farley_index"), security, coverage):
        out = out.join(part, key, "left")

    def parts(**full: float) -> Column:
        columns = [F.coalesce(name, F.lit(points)) for name, points in full.items()]
        return reduce(lambda a, b: a + b, columns)

    low = F.col("mutation_coverage") < F.col("mutation_floor")
    base = F.coalesce("base_points", F.lit(K.PILLAR_MAX[K.VERIFICATION]))
    out = out.select(
        key,
        F.round(parts(style=5.0, linter=10.0, dead_code=5.0), 6).alias(K.STATIC),
        F.round(parts(cyclomatic=15.0, cognitive=10.0), 6).alias(K.ARCHITECTURE),
        F.round(F.when(low, base * K.MUTATION_FACTOR).otherwise(base), 6).alias(K.VERIFICATION),
        parts(sast=10.0, sca=10.0).alias(K.SECURITY),
    )
    return out.withColumn("total", F.round(total(), 6))


def tiers(scores: DataFrame) -> DataFrame:
    """Operational tier of every total."""
    reached = [F.when(F.col("total") >= bound, name) for bound, name in K.TIERS]
    return scores.withColumn("tier", F.coalesce(*reached, F.lit(K.LOWEST_TIER)))


def finding_rollup(findings: DataFrame, key: str = "repo") -> DataFrame:
    """Counts by key, pillar and priority with all subtotals.

    Counted at the finest level first, so that the eight-fold expansion of the cube works
    on counts, not on findings.
    """
    base = findings.groupBy(key, "pillar", "priority").agg(F.count(F.lit(1)).alias("n"))
    return base.cube(key, "pillar", "priority").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n_findings")
    )
