"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from qscore import constants as K
from qscore.functions import code, paths, text
from qscore.operators import changes as chg
from qscore.operators import diffs as dif
from qscore.operators import duplicates as dup
from qscore.operators import findings as fnd
from qscore.operators import gate as gt
from qscore.operators import history as hst
from qscore.operators import lineage as lng
from qscore.operators import ranking as rnk
from qscore.operators import review as rev
from qscore.operators import scoring as scr
from qscore.plans import corpus, flows
from qscore.shared import fresh_path, materialize
from qscore.sources import commits as cmt
from qscore.sources import files as fls
from qscore.sources import policies as pol
from qscore.sources import reports as rpt
from qscore.sources import snapshots as snp
from qscore.streaming import detection as std
from qscore.streaming import trends as stt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TS = "2024-01-01T00:00:00Z"
_FILE = ("repo", "path")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------- shared inputs
def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fls.source_files(fls.exclude(corpus.files(spark, sf_dir)))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.findings(_sources(spark, sf_dir))


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repos(spark, sf_dir).select("repo")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scr.score(_findings(spark, sf_dir), _repos(spark, sf_dir))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.flatten(corpus.raw_policies(spark, sf_dir))


def _org_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scr.score(_findings(spark, sf_dir), corpus.repos(spark, sf_dir), blocking=True)


def _ranges(df: DataFrame) -> DataFrame:
    """Two ranges per repo that overlap: the later half of its sequence numbers, and the middle half."""
    ends = df.groupBy("repo").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return ends.selectExpr(
        "repo", "'org' || CAST(repo % 25 AS STRING) AS org",
        "inline(array(struct(repo * 2 AS range, (lo + hi) div 2 AS from_seq, hi AS to_seq),"
        " struct(repo * 2 + 1 AS range, (3 * lo + hi) div 4 AS from_seq, (lo + 3 * hi) div 4 AS to_seq)))",
    )


# -------------------------------------------------------------------- sources, paths
@query
def scan_files(spark, sf_dir):
    return fls.scan(spark, sf_dir, repo="tables").select("repo", "path", "size")


@query
def exclude_paths(spark, sf_dir):
    return fls.exclude(corpus.files(spark, sf_dir)).select(*_FILE)


@query
def exclude_paths_by_policy(spark, sf_dir):
    rules = fls.policy_regexes(pol.exclusion_patterns(_policies(spark, sf_dir)), key="org")
    files = corpus.files(spark, sf_dir).select(*_FILE)
    owned = files.withColumn("org", F.expr("'org' || CAST(repo % 25 AS STRING)"))
    return fls.exclude_by_policy(owned, rules, key="org").select(*_FILE)


@query
def unmatched_exclusions(spark, sf_dir):
    globs = [*K.DEFAULT_EXCLUSIONS, "**/nonexistent/**", "src/*.{py,rs}", "src/f?.go"]
    return fls.unmatched_exclusions(corpus.files(spark, sf_dir), globs, dimension=_repos(spark, sf_dir))


@query
def unmatched_by_policy(spark, sf_dir):
    patterns = pol.exclusion_patterns(_policies(spark, sf_dir))
    return fls.unmatched_by_policy(corpus.files(spark, sf_dir), corpus.repos(spark, sf_dir), patterns)


@query
def source_files(spark, sf_dir):
    return fls.source_files(corpus.files(spark, sf_dir)).select(*_FILE)


@query
def path_parts(spark, sf_dir):
    return fls.path_parts(corpus.files(spark, sf_dir))


@query
def non_code_files(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return files.where(paths.is_non_code(F.col("path"))).select(*_FILE)


@query
def snapshot_changes(spark, sf_dir):
    return chg.snapshot_changes(
        corpus.base_files(spark, sf_dir), corpus.target_files(spark, sf_dir)
    )


_VERSION = ("seq", "ln", "nr")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of files, each once: rows that repeat a version are alike. Written, as they are read several times."""
    return materialize(corpus.view(spark, sf_dir, "versions").distinct(), "versions")


@query
def range_changes(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    ranges = materialize(_ranges(versions), "ranges")
    return chg.range_changes(versions, ranges, order=_VERSION).drop("_last")


@query
def commits_in_range(spark, sf_dir):
    log = corpus.view(spark, sf_dir, "commit_log")
    return cmt.commits_in_range(log, _ranges(log).drop("org"))


def _history(spark: SparkSession, sf_dir: str) -> tuple[hst.Graph, DataFrame]:
    """The commit graph, and pairs (id, repo, base, target) of commits of all repos."""
    rows = materialize(corpus.view(spark, sf_dir, "commit_parents"), "commit-parents")
    first = rows.selectExpr("repo", "n AS commit", "0 AS nth", "p0 AS parent")
    second = rows.where("p1 is not null").selectExpr("repo", "n AS commit", "1 AS nth", "p1 AS parent")
    pairs = rows.where("n % 7 = 0").selectExpr("repo * 1000000 + n AS id", "repo", "n - 5 AS base", "n AS target")
    return hst.graph(first.unionByName(second)), pairs


@query
def reachable_commits(spark, sf_dir):
    """``base..target`` of every pair."""
    of, pairs = _history(spark, sf_dir)
    target, base = (pairs.select("id", "repo", F.col(c).alias("commit")) for c in ("target", "base"))
    return hst.reachable(of, target, base)


@query
def merge_bases(spark, sf_dir):
    return hst.merge_bases(*_history(spark, sf_dir))


def _changed(base: DataFrame, target: DataFrame) -> DataFrame:
    """The changed paths as a written table: found once, and of known size for later joins."""
    return materialize(chg.snapshot_changes(base, target), "changed")


@query
def changed_lines(spark, sf_dir):
    base, target = corpus.base_files(spark, sf_dir), corpus.target_files(spark, sf_dir)
    return chg.changed_lines(base, target, _changed(base, target))


def _diffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base, target = corpus.base_files(spark, sf_dir), corpus.target_files(spark, sf_dir)
    return base, materialize(dif.unified_diffs(base, target, _changed(base, target)), "diffs")


@query
def unified_diffs(spark, sf_dir):
    return _diffs(spark, sf_dir)[1]


@query
def patched_files(spark, sf_dir):
    """Each changed file, as the diff of its two versions makes it from the first one."""
    after = dif.apply_diffs(*_diffs(spark, sf_dir))
    return after.select(*_FILE, F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


@query
def line_change_counts(spark, sf_dir):
    """Lines that diffs add to and remove from each file, as one number: the files' lengths follow from it."""
    found = dif.line_changes(_diffs(spark, sf_dir)[1])
    sign = F.when(F.col("change") == "added", 1).otherwise(-1)
    return found.groupBy(*_FILE).agg(F.sum(sign).alias("net_lines"))


@query
def bucketed_changed_lines(spark, sf_dir):
    """As ``changed_lines``, over snapshots that are kept in buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, target = (snp.bucketed(f(spark, sf_dir), buckets) for f in (corpus.base_files, corpus.target_files))
    return chg.changed_lines(base, target, _changed(base, target))


@query
def diff_lines(spark, sf_dir):
    diffs = corpus.view(spark, sf_dir, "diffs")
    return chg.diff_lines(diffs, ("changeset", "part"))


@query
def policies(spark, sf_dir):
    return _policies(spark, sf_dir).withColumn(
        "exclusion_paths", F.array_join("exclusion_paths", ",")
    )


@query
def policy_violations(spark, sf_dir):
    return gt.violation(_policies(spark, sf_dir)).select("org", "violation")


# ------------------------------------------------------------------------- change sets
@query
def trivial_changes(spark, sf_dir):
    return chg.trivial_changes(corpus.view(spark, sf_dir, "changes"))


@query
def trivial_changesets(spark, sf_dir):
    return chg.trivial_changesets(corpus.view(spark, sf_dir, "changes"))


@query
def changeset_outcome(spark, sf_dir):
    return chg.changeset_outcome(
        corpus.view(spark, sf_dir, "changesets"), corpus.view(spark, sf_dir, "changes")
    )


@query
def changeset_scores(spark, sf_dir):
    target = corpus.target_files(spark, sf_dir)
    changed = _changed(corpus.base_files(spark, sf_dir), target)
    changed = changed.withColumn("changeset", F.col("repo") % 500)
    sets = _repos(spark, sf_dir).select((F.col("repo") % 500).alias("changeset")).distinct()
    return chg.changeset_scores(sets, changed, target)


@query
def changed_functions(spark, sf_dir):
    base, target = corpus.base_files(spark, sf_dir), corpus.target_files(spark, sf_dir)
    return chg.changed_functions(base, target, _changed(base, target))


@query
def finding_attribution(spark, sf_dir):
    return chg.attribution(_sources(spark, sf_dir), corpus.view(spark, sf_dir, "introductions"))


def _copy_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    versions = _versions(spark, sf_dir)
    return versions, materialize(lng.copy_events(lng.line_events(versions, _VERSION)), "copy-events")


@query
def line_intervals(spark, sf_dir):
    return lng.line_intervals(_copy_events(spark, sf_dir)[1])


@query
def living_lines(spark, sf_dir):
    """As of the ends of two ranges per repo."""
    versions, copies = _copy_events(spark, sf_dir)
    targets = _ranges(versions).select("range", "repo", F.col("to_seq").alias("at"))
    return lng.living_lines(copies, targets, _VERSION, key="range")


@query
def living_attribution(spark, sf_dir):
    """Findings of the last version of every file."""
    versions, copies = _copy_events(spark, sf_dir)
    newest = versions.groupBy(*_FILE).agg(F.max(F.struct(*_VERSION)).alias("v")).select(*_FILE, "v.*")
    files = versions.join(newest, [*_FILE, *_VERSION]).where("content is not null")
    return lng.living_attribution(files, lng.living_lines(copies, order=_VERSION), _VERSION)


# ----------------------------------------------------------------------- lines, texts
@query
def numbered_lines(spark, sf_dir):
    return fnd.numbered_lines(corpus.view(spark, sf_dir, "documents_in"), ("doc_id",), "text")


@query
def secret_findings(spark, sf_dir):
    return fnd.findings(_sources(spark, sf_dir), (fnd.secrets,))


@query
def diff_secret_findings(spark, sf_dir):
    return fnd.diff_secrets(corpus.view(spark, sf_dir, "diffs"), ("changeset", "part"))


@query
def scrub_secrets(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return files.select(*_FILE, text.scrub(F.col("content")).alias("scrubbed"))


@query
def redaction_counts(spark, sf_dir):
    return fnd.redaction_counts(corpus.files(spark, sf_dir))


@query
def truncated_locations(spark, sf_dir):
    rows = corpus.view(spark, sf_dir, "findings_in")
    return fnd.truncated_locations(rows, ("repo", "finding_id"), 20)


@query
def poor_names(spark, sf_dir):
    return fnd.findings(_sources(spark, sf_dir), (fnd.poor_names,))


@query
def function_segments(spark, sf_dir):
    return fnd.function_segments(_sources(spark, sf_dir))


@query
def nesting_depth(spark, sf_dir):
    return fnd.function_segments(_sources(spark, sf_dir)).select(
        *_FILE, "line_start", code.max_depth(F.col("body")).alias("depth")
    )


@query
def nesting_findings(spark, sf_dir):
    return fnd.findings(_sources(spark, sf_dir), (fnd.deep_nesting,))


@query
def cyclomatic(spark, sf_dir):
    return fnd.function_measures(_sources(spark, sf_dir)).select(
        *_FILE, "line_start", "complexity"
    )


@query
def all_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


# ----------------------------------------------------------------------------- scores
@query
def repo_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def pillar_scores(spark, sf_dir):
    found = fnd.findings(
        _sources(spark, sf_dir), (*fnd.DEFAULT_DETECTORS, fnd.poor_names)
    )
    return scr.score(found, _repos(spark, sf_dir))


@query
def mutation_penalty(spark, sf_dir):
    coverage = (
        corpus.view(spark, sf_dir, "test_quality")
        .groupBy("repo")
        .agg(F.min("mutation_coverage").alias("mutation_coverage"))
        .withColumn("mutation_floor", F.lit(K.DEFAULT_MUTATION_FLOOR))
    )
    return scr.apply_mutation_penalty(_scores(spark, sf_dir), coverage)


@query
def farley_index(spark, sf_dir):
    return scr.farley_index(corpus.view(spark, sf_dir, "test_quality"))


@query
def static_subscores(spark, sf_dir):
    return scr.static_subscores(corpus.view(spark, sf_dir, "lint"))


@query
def architecture_subscores(spark, sf_dir):
    return scr.architecture_subscores(fnd.function_measures(_sources(spark, sf_dir)))


@query
def security_subscores(spark, sf_dir):
    dimension = corpus.view(spark, sf_dir, "changesets").withColumnRenamed("changeset", "repo")
    return scr.security_subscores(
        dimension, corpus.view(spark, sf_dir, "sast"), corpus.view(spark, sf_dir, "sca")
    )


@query
def standard_scores(spark, sf_dir):
    dimension = _repos(spark, sf_dir)
    quality = corpus.view(spark, sf_dir, "test_quality")
    coverage = quality.groupBy("repo").agg(F.min("mutation_coverage").alias("mutation_coverage"))
    return scr.standard_scores(
        dimension,
        scr.static_subscores(corpus.view(spark, sf_dir, "lint")),
        scr.architecture_subscores(fnd.function_measures(_sources(spark, sf_dir))),
        scr.farley_index(quality),
        scr.security_subscores(dimension, corpus.view(spark, sf_dir, "sast"), corpus.view(spark, sf_dir, "sca")),
        coverage.withColumn("mutation_floor", F.lit(K.DEFAULT_MUTATION_FLOOR)),
    )


@query
def tiers(spark, sf_dir):
    return scr.tiers(corpus.view(spark, sf_dir, "score_history"))


@query
def finding_rollup(spark, sf_dir):
    return scr.finding_rollup(corpus.view(spark, sf_dir, "findings_in"))


@query
def gate(spark, sf_dir):
    return gt.gate(_org_scores(spark, sf_dir), _policies(spark, sf_dir), on="org").select(
        "repo", "total", "exit_code"
    )


@query
def gate_with_findings(spark, sf_dir):
    return gt.gate(
        _org_scores(spark, sf_dir), _policies(spark, sf_dir), on="org", hard_fail=True
    ).select("repo", "total", "blocking_findings", "exit_code")


@query
def check_workspaces(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "repo")
    return flows.check_workspaces(
        corpus.files(spark, sf_dir), corpus.repos(spark, sf_dir), _policies(spark, sf_dir), evaluations
    ).select("repo", "static", "architecture", "security", "total", "llm_enhanced", "exit_code")


def _pushes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change sets of 500 groups of repos, their changes between the two snapshots, the target (made once, read twice)."""
    target = materialize(corpus.target_files(spark, sf_dir), "target")
    changed = _changed(corpus.base_files(spark, sf_dir), target)
    changes = changed.selectExpr(
        "repo % 500 AS changeset", "repo", "path",
        "CASE change_type WHEN 'added' THEN ' ' ELSE '+x' END AS diff",
    )
    sets = corpus.repos(spark, sf_dir).selectExpr(
        "repo % 500 AS changeset", "'org' || CAST(repo % 500 % 25 AS STRING) AS org"
    )
    return sets.distinct(), changes, target


@query
def check_changesets(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "changeset")
    return flows.check_changesets(
        *_pushes(spark, sf_dir), _policies(spark, sf_dir), evaluations=evaluations
    )


@query
def flow_findings(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "repo")
    return flows.workspace_findings(
        corpus.files(spark, sf_dir), corpus.repos(spark, sf_dir), _policies(spark, sf_dir), evaluations
    )


@query
def blocking_findings(spark, sf_dir):
    found = materialize(_findings(spark, sf_dir), "findings")
    scores = scr.score(found, corpus.repos(spark, sf_dir), blocking=True)
    return gt.blocking_findings(scores, found, _policies(spark, sf_dir))


@query
def check_ranges(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "range")
    return flows.check_ranges(
        materialize(_ranges(versions), "ranges"), versions, _policies(spark, sf_dir), order=_VERSION, evaluations=evaluations
    )


@query
def score_regression(spark, sf_dir):
    dimension = _repos(spark, sf_dir)
    base = fls.source_files(corpus.base_files(spark, sf_dir))
    target = fls.source_files(corpus.target_files(spark, sf_dir))
    return gt.regression(
        scr.score(fnd.findings(base), dimension), scr.score(fnd.findings(target), dimension)
    )


# ------------------------------------------------------------------------- duplicates
@query
def duplicate_blocks(spark, sf_dir):
    return dup.duplicate_blocks(_sources(spark, sf_dir))


@query
def structural_duplicates(spark, sf_dir):
    return dup.duplicate_blocks(_sources(spark, sf_dir), normal=code.structure)


@query
def near_duplicates(spark, sf_dir):
    docs = corpus.view(spark, sf_dir, "documents_in").select("doc_id", "text")
    return dup.near_duplicates(docs)


# ---------------------------------------------------------------------------- reviews
@query
def pack_payload(spark, sf_dir):
    docs = corpus.view(spark, sf_dir, "documents_in")
    return rev.pack_payload(
        docs, key="source", name="doc_id", order=[F.col("doc_id")], content="text"
    )


@query
def airgap_filter(spark, sf_dir):
    return rev.may_send(_policies(spark, sf_dir)).select("org", "base_url")


@query
def review_requests(spark, sf_dir):
    return rev.review_requests(
        _sources(spark, sf_dir), corpus.repos(spark, sf_dir), _policies(spark, sf_dir)
    ).drop("system_prompt")


@query
def batch_review(spark, sf_dir):
    requests = rev.review_requests(
        _sources(spark, sf_dir), corpus.repos(spark, sf_dir), _policies(spark, sf_dir)
    )
    answers = rev.batch_review(requests, _reviewer)
    return rev.parse_reviews(answers.drop("ok")).drop("remediations")


@query
def changeset_requests(spark, sf_dir):
    """The changed functions of each change set, and their names."""
    sets, changes, target = _pushes(spark, sf_dir)
    changed = materialize(changes.select(*_FILE).distinct(), "changed-paths")
    functions = chg.changed_functions(corpus.base_files(spark, sf_dir), target, changed)
    asked = rev.changeset_requests(materialize(functions, "segments"), changes, sets, _policies(spark, sf_dir))
    return asked.drop("system_prompt").withColumn("segments", F.array_join("segments", ","))


@query
def resumed_review(spark, sf_dir):
    """Answers of a second run, whose model answers nothing: they come from the journal of the first."""
    requests = rev.review_requests(
        _sources(spark, sf_dir), corpus.repos(spark, sf_dir), _policies(spark, sf_dir)
    )
    requests, journal = materialize(requests, "requests"), fresh_path(spark, "journal")
    rev.batch_review(requests, _reviewer, journal=journal).write.format("noop").mode("overwrite").save()
    return rev.batch_review(requests, _silent, journal=journal).where("ok")


def _silent(request: dict) -> str:
    raise ConnectionError


def _reviewer(request: dict) -> str:
    """Stands for a model: half a point per 100 characters; never answers a very short payload."""
    payload = request["payload"]
    if len(payload) < 60:
        return "I cannot evaluate this code, sorry."
    return '{"pillar_adjustments":{"static_health_deduction":%s}}' % (len(payload) // 100 * 0.5)


@query
def parse_reviews(spark, sf_dir):
    return (
        rev.parse_reviews(corpus.view(spark, sf_dir, "review_attempts"))
        .withColumn("n_remediations", F.size("remediations"))
        .drop("remediations", "raw")
    )


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rev.first_success(corpus.view(spark, sf_dir, "review_attempts"))


@query
def first_success(spark, sf_dir):
    return _evaluations(spark, sf_dir).drop("remediations")


@query
def apply_deductions(spark, sf_dir):
    parsed = rev.parse_reviews(corpus.view(spark, sf_dir, "review_attempts"))
    return parsed.select(
        "review_id",
        "attempt",
        rev.deducted(F.lit(20.0), F.col("static_deduction")).alias("static"),
        rev.deducted(F.lit(25.0), F.col("architecture_deduction")).alias("architecture"),
    )


@query
def enhanced_scores(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "repo")
    return rev.enhance(_scores(spark, sf_dir), evaluations)


@query
def review_findings(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir).withColumnRenamed("review_id", "repo")
    return rev.review_findings(evaluations)


# -------------------------------------------------------------------- order, reports
@query
def ranked_findings(spark, sf_dir):
    return rnk.ranked(corpus.view(spark, sf_dir, "findings_in"))


@query
def top_findings(spark, sf_dir):
    return rnk.top_findings(corpus.view(spark, sf_dir, "findings_in"))


@query
def score_trend(spark, sf_dir):
    trend = rnk.score_trend(corpus.view(spark, sf_dir, "score_history"))
    return trend.drop("ts")


@query
def daily_scores(spark, sf_dir):
    daily = rnk.daily_scores(corpus.view(spark, sf_dir, "score_history"))
    return daily.withColumn("day", F.col("day").cast("string"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores and findings from one pass over the files: findings are few and written once."""
    found = materialize(_findings(spark, sf_dir), "findings")
    return scr.score(found, _repos(spark, sf_dir)), found


@query
def report_json(spark, sf_dir):
    return rpt.json_lines(*_scored(spark, sf_dir), RUN_TS)


@query
def report_markdown(spark, sf_dir):
    return rpt.markdown_lines(*_scored(spark, sf_dir))


@query
def read_reports(spark, sf_dir):
    path = fresh_path(spark, "reports")
    rpt.write_reports(*_scored(spark, sf_dir), RUN_TS, path)
    scores, findings = rpt.read_reports(spark, path)
    counts = scr.finding_counts(findings, ["repo"])
    again = scr.pillar_scores(scores.select("repo"), counts, ["repo"]).withColumnRenamed("total", "recomputed")
    places = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n_findings"), F.max("place").alias("last_place"))
    return scores.join(again.select("repo", "recomputed"), "repo").join(places, "repo", "left").select(
        F.col("repo").cast("bigint").alias("repo"), "total", "recomputed",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "last_place", "security",
    )


# -------------------------------------------------------------------------- streaming
def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = corpus.table(spark, sf_dir, table).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(sf_dir)


def _run(started) -> None:
    started.awaitTermination()


@query
def stream_secret_lines(spark, sf_dir):
    source, columns = corpus.VIEWS["code_lines"]
    lines = _stream(spark, sf_dir, source).selectExpr(
        *[c.replace("{S}", "STRING") for c in columns]
    )
    found = std.stream_secret_lines(lines.select("repo", "path", "ln", "line"))
    out, log = fresh_path(spark, "secrets"), fresh_path(spark, "log")
    _run(std.append_to(found, out, log, once=True))
    return spark.read.schema(found.schema).parquet(out)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive one batch after the other: written in several parts, one part per batch."""
    path = fresh_path(spark, "arrivals")
    files = corpus.files(spark, sf_dir)
    files.repartition(4, "path").write.parquet(path)
    return spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_findings(spark, sf_dir):
    found = std.stream_findings(_arrivals(spark, sf_dir))
    out, log = fresh_path(spark, "findings"), fresh_path(spark, "log")
    _run(std.append_to(found, out, log, once=True))
    return spark.read.schema(found.schema).parquet(out)


@query
def stream_repo_scores(spark, sf_dir):
    out, log = fresh_path(spark, "counts"), fresh_path(spark, "log")
    _run(std.count_batches(_arrivals(spark, sf_dir), out, log, once=True))
    return std.accumulated_scores(spark, out, _repos(spark, sf_dir))


@query
def stream_daily_scores(spark, sf_dir):
    source, columns = corpus.VIEWS["score_history"]
    reports = _stream(spark, sf_dir, source).selectExpr(*columns)
    daily = stt.stream_daily_scores(reports.withColumn("ts", F.col("ts").cast("timestamp")))
    out, log = fresh_path(spark, "daily"), fresh_path(spark, "log")
    _run(std.append_to(daily, out, log, once=True))
    return spark.read.schema(daily.schema).parquet(out).withColumn("day", F.col("day").cast("string"))
