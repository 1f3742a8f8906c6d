"""Policies and the pass, fail or error gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qscore import constants as K
from qscore.operators.scoring import tiers


def violation(policies: DataFrame) -> DataFrame:
    """Adds ``violation``: the first broken rule of a policy, null for a valid one.

    ``policies`` is flat, as :func:`qscore.sources.policies.flatten` gives it.
    """
    auth = F.when(F.col("auth_type") == "", "api_key").otherwise(F.col("auth_type"))
    threshold = F.col("target_threshold")
    out = F.when(~F.col("readable"), K.UNREADABLE_TEXT).when(
        ~threshold.between(0, 100),
        F.format_string(K.BAD_THRESHOLD_TEXT, threshold),
    ).when(~F.col("has_llm"), F.lit(None))
    out = out.when(~auth.isin(*K.AUTH_TYPES), F.format_string(K.BAD_AUTH_TEXT, auth))
    for field in K.OAUTH_FIELDS:
        missing = (auth == "oauth_browser") & (F.col(field) == "")
        out = out.when(missing, K.MISSING_FIELD_TEXT % field)
    return policies.withColumn("violation", out)


def gate(
    scores: DataFrame,
    policies: DataFrame,
    on: str = "repo",
    validate: bool = True,
    hard_fail: bool = False,
) -> DataFrame:
    """Exit code per score: 1 without a (valid) policy, 2 below its threshold, else 0.

    ``hard_fail`` needs ``blocking_findings`` in ``scores``: where the policy asks for it,
    any CRITICAL or HIGH finding of any pillar gives 2. The threshold is compared first; a
    total equal to it passes. ``validate=False`` leaves out the rules on the values of a policy;
    one that cannot be read is an error all the same.
    """
    judged = violation(policies) if validate else policies.withColumn(
        "violation", F.when(~F.col("readable"), K.UNREADABLE_TEXT)
    )
    rows = scores.join(
        judged.select(
            on, "target_threshold", "fail_on_critical_security", "violation",
            F.lit(True).alias("_known"),
        ),
        on,
        "left",
    )
    hard = (
        F.coalesce("fail_on_critical_security", F.lit(False)) & (F.col("blocking_findings") > 0)
        if hard_fail
        else F.lit(False)
    )
    exit_code = (
        F.when(F.col("_known").isNull() | F.col("violation").isNotNull(), K.EXIT_ERROR)
        .when(F.col("total") < F.col("target_threshold"), K.EXIT_FAIL)
        .when(hard, K.EXIT_FAIL)
        .otherwise(K.EXIT_PASS)
    )
    return rows.select(*scores.columns, exit_code.alias("exit_code"))


def regression(base: DataFrame, target: DataFrame, key: str = "repo") -> DataFrame:
    """Base and target totals, whether the score fell, and the verdict.

    A target in the technical-debt tier that fell is blocked, and so is any in the lowest tier.
    """
    pair = base.select(key, F.col("total").alias("base_total")).join(
        tiers(target).select(key, F.col("total").alias("target_total"), "tier"), key
    )
    fell = F.col("target_total") < F.col("base_total")
    debt = K.TIERS[-1][1]
    return pair.select(
        "*",
        (F.col("target_total") - F.col("base_total")).alias("delta"),
        fell.alias("regressed"),
        (((F.col("tier") == debt) & fell) | (F.col("tier") == K.LOWEST_TIER)).alias("blocked"),
    )


def blocking_findings(gated: DataFrame, findings: DataFrame, policies: DataFrame, on: str = "org", key: str = "repo") -> DataFrame:
    """The findings that block: CRITICAL or HIGH ones of keys that their policy fails for them.

    ``gated`` (key, ``on``, total) as it was judged; a key below its threshold is blocked by its total,
    not by findings, and one without a valid policy is an error.
    """
    asking = violation(policies).where(F.col("violation").isNull() & F.col("fail_on_critical_security"))
    strict = gated.join(asking.select(on, "target_threshold"), on).where("total >= target_threshold")
    severe = findings.where(F.col("severity").isin(*K.BLOCKING_SEVERITIES))
    return severe.join(strict.select(key), key, "left_semi")
