"""What differs between snapshots, and how a change set is judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from qscore import constants as K
from qscore.functions import paths, text
from qscore.operators import findings as fnd, scoring
from qscore.operators.fetch import likely
from qscore.operators.skew import hot_groups, join_few
from qscore.shared import materialize

_FILE = ("repo", "path")


def snapshot_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """(repo, path, change_type) of files added, deleted or modified.

    ``base`` is the snapshot at the merge base. Only hashes are shuffled, never content.
    """

    def hashed(files: DataFrame, name: str) -> DataFrame:
        return files.select(*_FILE, F.sha2(F.col("content").cast("binary"), 256).alias(name))

    both = hashed(base, "_b").join(hashed(target, "_t"), list(_FILE), "full_outer")
    kind = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_t").isNull(), "deleted")
        .otherwise("modified")
    )
    return both.where(~F.col("_b").eqNullSafe(F.col("_t"))).select(
        *_FILE, kind.alias("change_type")
    )


def range_changes(
    versions: DataFrame, ranges: DataFrame, order: Sequence[str] = ("seq",), key: str = "range"
) -> DataFrame:
    """Files that differ between the two ends of a commit range.

    ``versions``: (repo, path, seq, content), null content for a deletion; ``ranges``:
    (key, repo, from_seq, to_seq), any number per repo, overlapping or not. One aggregation
    finds both end states of each; a file changed and changed back is not listed. ``_last`` (the
    order columns) says which version is the last of the range. ``order`` starts with seq and is total within a file.
    ``versions`` are read more than once, so written ones are best.
    """
    stamped = versions.select(
        *_FILE, F.struct(*order, F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("h")).alias("v")
    )
    asked = ranges.select(key, "repo", "from_seq", "to_seq")
    if hot_groups(versions, ("repo",)) is None:
        # Dealt out by repo once: what has met the ranges there is aggregated where it lies.
        ranged = stamped.join(asked.hint("merge"), "repo")
    else:
        ranged = join_few(stamped, asked, "repo", spread=("path",))
    ends = (
        ranged.where(F.col("v.seq") <= F.col("to_seq"))
        .groupBy(key, *_FILE)
        .agg(
            F.max(F.when(F.col("v.seq") <= F.col("from_seq"), F.col("v")))["h"].alias("_b"),
            F.max("v").alias("_t"),
        )
    )
    last = F.struct(*[F.col("_t")[c].alias(c) for c in order]).alias("_last")
    return ends.where(~F.col("_b").eqNullSafe(F.col("_t.h"))).select(key, *_FILE, last)


def range_scores(
    ranges: DataFrame,
    changed: DataFrame,
    versions: DataFrame,
    order: Sequence[str] = ("seq",),
    key: str = "range",
) -> tuple[DataFrame, DataFrame]:
    """(scores, findings) of commit ranges over the changed source files as each range leaves them.

    ``changed`` is what :func:`range_changes` gives, best written before. Only the versions that end
    a range are opened.
    """
    ends = changed.where(paths.is_source(F.col("path"))).select(key, *_FILE, "_last.*")
    last = likely(versions.where(F.col("content").isNotNull()), ends, (*_FILE, *order)).join(ends, [*_FILE, *order])
    found = fnd.findings(last, keys=(key, "repo"))
    counts = scoring.finding_counts(found, [key])
    return scoring.pillar_scores(ranges.select(key).distinct(), counts, [key]), found


def opened(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files that are in ``changed`` (repo, path); null content is no file. Only their content is shuffled, if
    any is: a Bloom filter tests the others where they lie. ``changed`` is read several times."""
    named = changed.select(*_FILE)
    return likely(files.where(F.col("content").isNotNull()), named, _FILE).join(named, list(_FILE), "left_semi")


def changed_lines(base: DataFrame, target: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(repo, path, change, line, copies): lines added to and removed from each file.

    Bags of lines are compared, so a moved line is no change. Only files in ``changed``
    are opened (default: :func:`snapshot_changes`, written; pass a written table, as it is read
    several times). Lines are counted before they are shuffled.
    """
    if changed is None:
        changed = materialize(snapshot_changes(base, target), "changed")

    def counted(files: DataFrame, sign: int) -> DataFrame:
        return opened(files, changed).select(
            *_FILE,
            F.explode(text.lines_of(F.col("content"))).alias("line"),
            F.lit(sign).alias("sign"),
        )

    net = (
        counted(target, 1)
        .unionByName(counted(base, -1))
        .groupBy(*_FILE, "line")
        .agg(F.sum("sign").alias("net"))
        .where("net <> 0")
    )
    return net.select(
        *_FILE,
        F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"),
        "line",
        F.abs("net").alias("copies"),
    )


def diff_lines(diffs: DataFrame, keys: Sequence[str], column: str = "diff") -> DataFrame:
    """Lines of unified diffs with their kind: header, added, removed or context."""
    line = F.col("line")
    kind = (
        F.when(line.rlike(r"^(\+\+\+ |--- |@@ |diff |index )"), "header")
        .when(line.startswith("+"), "added")
        .when(line.startswith("-"), "removed")
        .otherwise("context")
    )
    return fnd.numbered_lines(diffs, keys, column).withColumn("kind", kind)


def trivial_changes(changes: DataFrame) -> DataFrame:
    """Adds ``is_trivial`` (non-code, or a white-space-only diff that is not empty) and the message."""
    diff = F.coalesce("diff", F.lit(""))
    trivial = paths.is_non_code(F.col("path")) | ((diff != "") & text.is_blank(diff))
    return changes.select(
        "*",
        trivial.alias("is_trivial"),
        F.when(trivial, F.concat(F.lit(K.TRIVIAL_TEXT), "path")).alias("message"),
    )


def trivial_changesets(changes: DataFrame, key: str = "changeset") -> DataFrame:
    """Change sets all of whose changes are trivial: they pass without scoring."""
    return (
        trivial_changes(changes)
        .groupBy(key)
        .agg(F.bool_and("is_trivial").alias("all"), F.count(F.lit(1)).alias("n_changes"))
        .where("all")
        .drop("all")
    )


def changeset_outcome(
    changesets: DataFrame, changes: DataFrame, key: str = "changeset", skip_trivial: bool = True
) -> DataFrame:
    """(key, n_changes, outcome, exit_code) of every change set.

    ``no_changes`` and ``trivial`` pass at once (exit 0); ``scored`` ones have no code
    yet. Commit ranges know no trivial rule: ``skip_trivial=False``.
    """
    per = (
        trivial_changes(changes)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_trivial").alias("all"))
    )
    skipped = F.lit(skip_trivial) & F.coalesce("all", F.lit(False))
    return changesets.join(per, key, "left").select(
        key,
        F.coalesce("n", F.lit(0)).alias("n_changes"),
        F.when(F.col("n").isNull(), "no_changes")
        .when(skipped, "trivial")
        .otherwise("scored")
        .alias("outcome"),
        F.when(F.col("n").isNull() | skipped, K.EXIT_PASS).alias("exit_code"),
    )


def changeset_scores(
    changesets: DataFrame, changes: DataFrame, target: DataFrame, key: str = "changeset"
) -> DataFrame:
    """Pillars of every change set over its changed source files as they are in ``target``.

    Exclusions do not apply here, and deleted files have no findings. Findings are
    counted per file where the file lies, so counts meet the changes and content never
    moves. Files that a Bloom filter of the changed paths rules out are not opened. A file in very many
    change sets is spread by change set.
    """
    sources = likely(target.where(paths.is_source(F.col("path"))), changes.select(*_FILE).distinct(), _FILE)
    per_file = scoring.finding_counts(fnd.findings(sources, keys=_FILE), _FILE)
    touched = join_few(changes.select(key, *_FILE), per_file, list(_FILE), spread=(key,))
    counts = touched.groupBy(key).agg(
        F.sum("n_static").alias("n_static"),
        F.sum("n_architecture").alias("n_architecture"),
        F.bool_or("has_breach").alias("has_breach"),
    )
    return scoring.pillar_scores(changesets, counts, [key])


def attribution(
    files: DataFrame, introductions: DataFrame, detectors=fnd.DEFAULT_DETECTORS
) -> DataFrame:
    """Findings with the commit that introduced them: the first to add their first line.

    ``introductions``: (repo, path, seq, hash, line), one row per added line. They are
    reduced to one row per distinct line before the join.
    """
    path, content = F.col("path"), F.col("content")

    def with_text(lines):
        found = F.concat(*[d(path, content, lines) for d in detectors])
        return F.transform(
            found,
            lambda f: F.struct(
                f["line_start"].alias("line_start"),
                f["pillar"].alias("pillar"),
                F.get(lines, f["line_start"] - 1).alias("line"),
            ),
        )

    found = files.select(*_FILE, F.inline(text.bind(text.lines_of(content), with_text)))
    first = introductions.groupBy(*_FILE, "line").agg(
        F.min(F.struct("seq", "hash")).alias("first")
    )
    return found.join(first, [*_FILE, "line"], "left").select(
        *_FILE,
        "pillar",
        "line_start",
        F.col("first.seq").alias("seq"),
        F.col("first.hash").alias("hash"),
    )


def changed_functions(base: DataFrame, target: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Functions of ``target`` that hold an added line: the least that a review must see.

    One row per function: repo, path, line_start, line_end, code (header and body).
    """
    lines = changed_lines(base, target, changed).where("change = 'added'").select(*_FILE, "line")
    added = materialize(lines, "added-lines")
    sources = target.where(paths.is_source(F.col("path")))
    functions = fnd.function_segments(opened(sources, added.select(*_FILE).distinct())).select(
        *_FILE,
        "line_start",
        "line_end",
        F.when(F.col("line_end") > F.col("line_start"), F.concat_ws("\n", "header", "body"))
        .otherwise(F.col("header"))
        .alias("code"),
    )
    per_line = functions.select(
        *_FILE, "line_start", F.explode(F.array_distinct(text.lines_of(F.col("code")))).alias("line")
    )
    hit = per_line.join(added, [*_FILE, "line"], "left_semi").select(*_FILE, "line_start").distinct()
    return functions.join(hit, [*_FILE, "line_start"], "left_semi")
