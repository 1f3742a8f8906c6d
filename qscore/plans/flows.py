"""The three ways to judge code, each for any number of repositories.

Findings are written once, below the shared folder, when a flow is set up; what follows is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from qscore import constants as K
from qscore.functions import paths
from qscore.operators import changes as chg, findings as fnd, gate as gt, review as rev, scoring as scr
from qscore.shared import materialize
from qscore.sources import files as fls


def check_workspaces(
    files: DataFrame,
    repos: DataFrame,
    policies: DataFrame,
    evaluations: DataFrame | None = None,
    on: str = "org",
    detectors: Sequence[fnd.Detector] = fnd.DEFAULT_DETECTORS,
    hard_fail: bool = False,
) -> DataFrame:
    """Whole snapshots: detect, exclude, score, merge reviews, gate. Policies are validated.

    Exclusions differ from repo to repo, so applying them means a join. It is done on the
    findings, which are few and written once, and not on the files, whose content would
    move: a finding in an excluded file is dropped, as if the file had not been read.
    ``evaluations`` (repo, the two deductions) are the usable answers to
    :func:`qscore.operators.review.review_requests`; repos without one keep their score, and so do
    those whose policy lets nothing out. :func:`workspace_findings` gives what was found.
    """
    kept = workspace_findings(files, repos, policies, on=on, detectors=detectors)
    return judge_workspaces(kept, repos, policies, evaluations, on, hard_fail)


def workspace_findings(
    files: DataFrame,
    repos: DataFrame,
    policies: DataFrame,
    evaluations: DataFrame | None = None,
    on: str = "org",
    detectors: Sequence[fnd.Detector] = fnd.DEFAULT_DETECTORS,
) -> DataFrame:
    """Findings of whole snapshots outside of excluded paths; with ``evaluations``, also what reviewers
    remarked, for reports: such findings must not be scored."""
    found = materialize(fnd.findings(fls.source_files(files), detectors), "findings")
    kept = fls.exclude_by_policy(found, fls.exclusion_rules(repos, policies, on), path="location")
    if evaluations is None:
        return kept
    return kept.unionByName(rev.review_findings(_sent(evaluations, repos, policies, on)))


def _sent(evaluations: DataFrame, repos: DataFrame, policies: DataFrame, on: str, key: str = "repo") -> DataFrame:
    """Evaluations of keys whose policy lets text out."""
    sending = repos.join(rev.may_send(policies).select(on), on).select(key)
    return evaluations.join(sending, key, "left_semi")


def judge_workspaces(
    findings: DataFrame,
    repos: DataFrame,
    policies: DataFrame,
    evaluations: DataFrame | None = None,
    on: str = "org",
    hard_fail: bool = False,
) -> DataFrame:
    """Score, merge reviews, gate, from findings."""
    scores = scr.score(findings, repos, blocking=True)
    if evaluations is not None:
        scores = rev.enhance(scores, _sent(evaluations, repos, policies, on))
    return gt.gate(scores, policies, on=on, hard_fail=hard_fail)


def check_changesets(
    changesets: DataFrame,
    changes: DataFrame,
    target: DataFrame,
    policies: DataFrame,
    on: str = "org",
    key: str = "changeset",
    skip_trivial: bool = True,
    evaluations: DataFrame | None = None,
) -> DataFrame:
    """Change sets: empty and trivial ones pass at once, the others are scored and gated.

    ``changesets``: (key, ``on``); ``changes``: (key, repo, path, diff). Only changed
    source files of scored change sets count; exclusions do not apply and the values of policies are
    not validated, but a policy that is missing or cannot be read is an error before anything is looked at.
    ``evaluations`` (key, the two deductions) are merged where the policy lets text out. ``total`` is
    null where nothing was scored.
    """
    readable = _readable(changesets, policies, on, key)
    outcome = chg.changeset_outcome(changesets.select(key), changes, key, skip_trivial)
    open_sets = outcome.where("outcome = 'scored'").join(readable, key, "left_semi").select(key)
    touched = changes.where(paths.is_source(F.col("path"))).join(open_sets, key, "left_semi")
    scores = chg.changeset_scores(changesets.join(open_sets, key, "left_semi"), touched, target, key)
    return _judge_sets(scores, outcome, changesets, readable, policies, on, key, evaluations)


def _readable(sets: DataFrame, policies: DataFrame, on: str, key: str) -> DataFrame:
    return sets.join(policies.where("readable").select(on), on).select(key)


def _judge_sets(
    scores: DataFrame,
    outcome: DataFrame,
    sets: DataFrame,
    readable: DataFrame,
    policies: DataFrame,
    on: str,
    key: str,
    evaluations: DataFrame | None,
) -> DataFrame:
    if evaluations is not None:
        scores = rev.enhance(scores, _sent(evaluations, sets, policies, on, key), key)
    gated = gt.gate(scores.join(sets.select(key, F.col(on).alias("_on")), key), policies.withColumnRenamed(on, "_on"), on="_on", validate=False)
    gated = gated.select(key, "total", F.col("exit_code").alias("_code"))
    known = readable.select(key, F.lit(True).alias("_known"))
    return outcome.join(gated, key, "left").join(known, key, "left").select(
        key,
        "n_changes",
        "outcome",
        "total",
        F.when(F.col("_known").isNull(), K.EXIT_ERROR)
        .otherwise(F.coalesce("exit_code", "_code", F.lit(K.EXIT_ERROR)))
        .alias("exit_code"),
    )


def check_ranges(
    ranges: DataFrame,
    versions: DataFrame,
    policies: DataFrame,
    on: str = "org",
    key: str = "range",
    order: Sequence[str] = ("seq",),
    evaluations: DataFrame | None = None,
) -> DataFrame:
    """Commit ranges: the files that differ between their ends are scored as the range leaves them, and
    gated. ``ranges``: (key, ``on``, repo, from_seq, to_seq); ``versions``: (repo, path, seq, content).

    There is no rule for trivial changes; else as :func:`check_changesets`.
    """
    sets = ranges.select(key, on).distinct()
    readable = _readable(sets, policies, on, key)
    changed = materialize(chg.range_changes(versions, ranges, order, key), "range-changes")
    counts = changed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    outcome = sets.join(counts, key, "left").select(
        key,
        F.coalesce("_n", F.lit(0)).alias("n_changes"),
        F.when(F.col("_n").isNull(), "no_changes").otherwise("scored").alias("outcome"),
        F.when(F.col("_n").isNull(), K.EXIT_PASS).alias("exit_code"),
    )
    open_sets = outcome.where("outcome = 'scored'").join(readable, key, "left_semi").select(key)
    scores, _ = chg.range_scores(open_sets, changed.join(open_sets, key, "left_semi"), versions, order, key)
    return _judge_sets(scores, outcome, sets, readable, policies, on, key, evaluations)
