import pytest
from pyspark.sql import functions as F

from qscore.operators import gate as gt, scoring
from qscore.sources import policies as pol


def _repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "repo string")


def _scores(spark, findings, *repos):
    rows = spark.createDataFrame(findings, "repo string, pillar string, severity string")
    return {r.repo: r for r in scoring.score(rows, _repos(spark, *repos)).collect()}


def test_pillars(spark):
    rows = (
        [("a", "architecture", None)] * 3
        + [("b", "static", None)] * 5
        + [("c", "security", "MEDIUM"), ("d", "security", "CRITICAL"), ("e", "security", "high")]
        + [("f", "architecture", None)] * 30
        + [("g", "static", None)] * 50
    )
    got = _scores(spark, rows, *"abcdefgh")
    assert {k: v.total for k, v in got.items()} == {
        "a": 97.0, "b": 97.5, "c": 100.0, "d": 80.0, "e": 100.0, "f": 75.0, "g": 80.0, "h": 100.0,
    }
    for row in got.values():
        assert row.total == row.static + row.architecture + row.verification + row.security
        assert 0 <= row.total <= 100


@pytest.mark.parametrize(
    "total,threshold,hard,severity,code",
    [
        (75.0, 75.0, None, None, 0), (74.0, 75.0, None, None, 2), (0.0, 0.0, None, None, 0),
        (99.0, 100.0, None, None, 2), (100.0, 75.0, True, "CRITICAL", 2), (100.0, 75.0, True, "HIGH", 2),
        (100.0, 75.0, True, "MEDIUM", 0), (100.0, 75.0, True, "LOW", 0), (100.0, 75.0, False, "HIGH", 0),
        (100.0, 75.0, None, "CRITICAL", 0), (50.0, None, None, None, 0), (50.0, 150.0, None, None, 1),
        (50.0, -1.0, None, None, 1),
    ],
)
def test_gate(spark, total, threshold, hard, severity, code):
    raw = {"target_threshold": threshold, "fail_on_critical_security": hard}
    import json

    policies = pol.flatten(
        spark.createDataFrame(
            [("r", json.dumps({"gate": {k: v for k, v in raw.items() if v is not None}}))],
            "repo string, raw string",
        ),
        key="repo",
    )
    blocking = 1 if severity in ("CRITICAL", "HIGH") else 0
    scores = spark.createDataFrame(
        [("r", total, blocking)], "repo string, total double, blocking_findings long"
    )
    assert gt.gate(scores, policies, hard_fail=True).first().exit_code == code
    plain = 0 if code == 2 and blocking and total >= (threshold or 0) else code
    assert gt.gate(scores, policies).first().exit_code == plain


def test_gate_without_policy(spark):
    scores = spark.createDataFrame([("r", 100.0)], "repo string, total double")
    none = pol.flatten(spark.createDataFrame([("x", "{}")], "repo string, raw string"), "repo")
    assert gt.gate(scores, none).first().exit_code == 1


@pytest.mark.parametrize(
    "raw,violation",
    [
        ("{}", None),
        ("null", None),
        ('{"gate": {"target_threshold": 150}}', "target_threshold must be between 0 and 100, got 150.000000"),
        ('{"gate": {"llm": {"auth_type": "kerberos"}}}', "unsupported auth_type: \"kerberos\"; must be 'api_key' or 'oauth_browser'"),
        ('{"gate": {"llm": {}}}', None),
        ('{"gate": {"llm": {"auth_type": "oauth_browser"}}}', "oauth_token_url is required when auth_type is 'oauth_browser'"),
        (
            '{"gate": {"llm": {"auth_type": "oauth_browser", "oauth_token_url": "t", "oauth_auth_url": "a"}}}',
            "oauth_client_id_env_var is required when auth_type is 'oauth_browser'",
        ),
        ('{"gate": ', "policy is not valid JSON"),
        ('{"gate": {"target_threshold": "75"}}', "policy is not valid JSON"),
        ('{"gate": {"llm": {"base_url": 5}}}', "policy is not valid JSON"),
        ("{} trailing", "policy is not valid JSON"),
    ],
)
def test_policy_validation(spark, raw, violation):
    rows = spark.createDataFrame([("o", raw)], "org string, raw string")
    assert gt.violation(pol.flatten(rows)).first().violation == violation


def test_read_policies(spark, tmp_path):
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "policy.json").write_text(
        '{\n "gate": {"target_threshold": 75},\n "exclusions": {"paths": ["**/x/**"]}\n}'
    )
    (row,) = pol.flatten(pol.read_policies(spark, str(tmp_path))).collect()
    assert (row.org, row.target_threshold, row.exclusion_paths) == ("acme", 75.0, ["**/x/**"])
    assert row.data_scrubbing is None and row.allow_public_cloud_transmission is None


@pytest.mark.parametrize(
    "coverage,expected", [(70.0, 28.0), (0.0, 28.0), (80.0, 35.0), (90.0, 35.0), (100.0, 35.0), (None, 35.0)]
)
def test_mutation_penalty(spark, coverage, expected):
    scores = scoring.score(
        spark.createDataFrame([], "repo string, pillar string, severity string"), _repos(spark, "r")
    )
    rows = spark.createDataFrame(
        [("r", coverage, 80.0)], "repo string, mutation_coverage double, mutation_floor double"
    )
    got = scoring.apply_mutation_penalty(scores, rows).first()
    assert (got.verification, got.total) == (expected, 65.0 + expected)
    message = "Mutation coverage 70% is below the 80% floor; Verification pillar penalized by 20%"
    assert got.penalty_message == (message if coverage == 70.0 else got.penalty_message)
    assert (got.penalty_message is None) == (expected == 35.0)


def test_farley(spark):
    rows = spark.createDataFrame([("r",) + (10,) * 8], "repo string, u int, m int, r int, a int, n int, g int, f int, t int")
    assert scoring.farley_index(rows).first().farley_index == 10.0


def test_tiers(spark):
    rows = spark.createDataFrame([(t,) for t in (90.0, 89.5, 75.0, 74.5, 60.0, 59.5)], "total double")
    got = [r.tier for r in scoring.tiers(rows).collect()]
    assert got == ["Elite Tier", "Target Standard", "Target Standard", "Technical Debt Alert",
                   "Technical Debt Alert", "Critical Remediate Status"]


def test_regression(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "repo string, total double")

    base = frame([("up", 60.0), ("down", 74.0), ("elite", 100.0), ("low", 10.0)])
    target = frame([("up", 61.0), ("down", 73.5), ("elite", 91.0), ("low", 20.0)])
    got = {r.repo: (r.regressed, r.blocked) for r in gt.regression(base, target).collect()}
    assert got == {"up": (False, False), "down": (True, True), "elite": (True, False), "low": (False, True)}


def test_subscores(spark):
    lint = spark.createDataFrame(
        [("r", True, 1, False), ("r", False, 4, False), ("q", True, 30, True)],
        "repo string, is_clean boolean, warnings int, has_dead_code boolean",
    )
    got = {r.repo: (r.style, r.linter, r.dead_code) for r in scoring.static_subscores(lint).collect()}
    assert got == {"r": (2.5, 7.5, 5.0), "q": (5.0, 0.0, 0.0)}


def test_rollup_subtotals(spark):
    rows = spark.createDataFrame(
        [("r", "static", "LOW"), ("r", "static", "LOW"), ("q", "security", "HIGH")],
        "repo string, pillar string, priority string",
    )
    cube = scoring.finding_rollup(rows)
    assert cube.where("level = 7").first().n_findings == 3
    assert cube.where(F.col("level") == 3).count() == 2
