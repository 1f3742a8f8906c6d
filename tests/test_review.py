import json

import pytest
from pyspark.sql import functions as F

from qscore import constants as K
from qscore.functions import text
from qscore.operators import review as rev, scoring

GOOD = json.dumps(
    {
        "pillar_adjustments": {"static_health_deduction": 5.0, "architecture_deduction": 2.5},
        "remediations": [
            {"priority": "HIGH", "pillar": "static", "location": "main.go:lines 3-9", "finding": "f", "actionable_fix": "x"}
        ],
    }
)


@pytest.mark.parametrize(
    "raw,ok,deductions",
    [
        (GOOD, True, (5.0, 2.5)),
        ("{}", True, (0.0, 0.0)),
        ("null", True, (0.0, 0.0)),
        ('{"pillar_adjustments": null, "remediations": null}', True, (0.0, 0.0)),
        ('{"other": [1, {"priority": 5}]}', True, (0.0, 0.0)),
        ("I cannot evaluate this code, sorry.", False, (0.0, 0.0)),
        ("", False, (0.0, 0.0)),
        ("[1,2", False, (0.0, 0.0)),
        ("[]", False, (0.0, 0.0)),
        ("5", False, (0.0, 0.0)),
        ("{} trailing", False, (0.0, 0.0)),
        ("{},{}", False, (0.0, 0.0)),
        ("{}],[{}", False, (0.0, 0.0)),
        ('{"pillar_adjustments": {"static_health_deduction": "5"}}', False, (0.0, 0.0)),
        ('{"remediations": [{"priority": 1}]}', False, (0.0, 0.0)),
        ('{"remediations": {"priority": "HIGH"}}', False, (0.0, 0.0)),
        ('{"pillar_adjustments": {"static_health_deduction": 3}}', True, (3.0, 0.0)),
    ],
)
def test_strict_answers(spark, raw, ok, deductions):
    got = rev.parse_reviews(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (got.ok, (got.static_deduction, got.architecture_deduction)) == (ok, deductions)
    python_ok = False
    try:
        python_ok = rev._usable(json.loads(raw))
    except ValueError:
        pass
    assert python_ok is ok


def _scores(spark):
    none = spark.createDataFrame([], "repo string, pillar string, severity string")
    return scoring.score(none, spark.createDataFrame([("r",), ("s",)], "repo string"))


@pytest.mark.parametrize(
    "raw,static,architecture,total",
    [
        (GOOD, 15.0, 22.5, 92.5),
        ('{"pillar_adjustments":{"static_health_deduction":999,"architecture_deduction":-5}}', 0.0, 25.0, 80.0),
    ],
)
def test_merge(spark, raw, static, architecture, total):
    log = spark.createDataFrame(
        [("r", 1, "nonsense"), ("r", 2, ""), ("r", 3, raw), ("s", 1, "no"), ("s", 2, "no"), ("s", 3, "no"), ("s", 4, raw)],
        "repo string, attempt int, raw string",
    )
    first = rev.first_success(log, key="repo")
    got = {x.repo: x for x in rev.enhance(_scores(spark), first).collect()}
    assert (got["r"].static, got["r"].architecture, got["r"].total, got["r"].llm_enhanced) == (
        static, architecture, total, True,
    )
    assert (got["s"].total, got["s"].llm_enhanced) == (100.0, False)
    assert first.collect()[0].attempt == 3
    extra = rev.review_findings(first).collect()
    assert [(e.location, e.line_start, e.severity) for e in extra] == (
        [("main.go:lines 3-9", 0, None)] if raw == GOOD else []
    )


def test_scrub(spark):
    code = (
        'apiKey := "sk-1234567890abcdef"\npassword := "supersecret123"\npwd: "yaml-stays"\n'
        "Authorization: bearer abc.def-1==\n-----BEGIN RSA PRIVATE KEY-----\nbody stays\nsecret =\n 'over lines'"
    )
    row = spark.createDataFrame([(code,)], "c string")
    once = text.scrub(F.col("c"))
    got = row.select(once, text.scrub(once), F.array(*text.redactions(F.col("c")))).first()
    assert got[0] == (
        '[REDACTED]\n[REDACTED]\npwd: "yaml-stays"\nAuthorization: [REDACTED]\n[REDACTED]\nbody stays\n[REDACTED]'
    )
    assert got[1] == got[0]
    assert got[2] == [1, 2, 0, 1, 1]


def _reference_pack(files, cap):
    """The packing rule, one file after another."""
    out = b""
    for path, content in files:
        header, data = f"=== {path} ===\n".encode(), content.encode()
        if len(out) + len(header) + len(data) > cap:
            out += K.PAYLOAD_MARKER.encode()
            break
        out += header + data + b"\n"
    return out.decode().strip()


@pytest.mark.parametrize("cap", [20, 40, 41, 42, 60, 100, 24576])
def test_pack(spark, cap):
    files = {
        "one": [("a.go", "x" * 9), ("a/b.go", "é" * 4), ("a-b.go", ""), ("b.go", "y" * 30), ("c.go", "z")],
        "big": [("a.go", "x" * 30000), ("b.go", "z")],
        "edge": [("a.go", "q" * (cap - 13)), ("b.go", "")],
        "many": [(f"f{i:04d}.go", "") for i in range(3000)],
    }
    rows = [(r, p, c) for r, fs in files.items() for p, c in fs]
    packed = rev.pack_payload(
        spark.createDataFrame(rows, "repo string, path string, content string"), cap=cap
    )
    got = {r.repo: r.payload for r in packed.collect()}
    assert got == {
        r: _reference_pack(sorted(fs, key=lambda f: f[0].split("/")), cap) for r, fs in files.items()
    }


def test_airgap_comes_first(spark):
    rows = [("off", False, "u"), ("on", True, "u"), ("unset", None, "u"), ("none", None, "")]
    policies = spark.createDataFrame(
        rows, "org string, allow_public_cloud_transmission boolean, base_url string"
    )
    assert {r.org for r in rev.may_send(policies).collect()} == {"on", "unset"}


def test_requests_are_scrubbed_unless_switched_off(spark):
    policies = spark.createDataFrame(
        [("o1", None, None), ("o2", None, False), ("o3", False, None)],
        "org string, allow_public_cloud_transmission boolean, data_scrubbing boolean",
    ).selectExpr("*", "'u' AS base_url", "'m' AS model_name", "0D AS temperature", "0 AS timeout_ms",
        "array('secrets/**') AS exclusion_paths")
    repos = spark.createDataFrame([(f"r{i}", f"o{i}") for i in (1, 2, 3)] + [("empty", "o1")], "repo string, org string")
    files = spark.createDataFrame(
        [(f"r{i}", p, 'password = "abcd"') for i in (1, 2, 3) for p in ("a.go", "secrets/b.go")], "repo string, path string, content string"
    )
    got = {r.repo: r.payload for r in rev.review_requests(files, repos, policies).collect()}
    assert got == {"r1": "=== a.go ===\n[REDACTED]", "r2": '=== a.go ===\npassword = "abcd"'}


def test_batch_review_retries(spark):
    requests = spark.createDataFrame(
        [("fine", "p", "{}"), ("bad", "p", "oops"), ("down", "p", "raise")],
        "repo string, system_prompt string, payload string",
    )

    def ask(request):
        assert request["base_url"] == "u" and request["timeout_ms"] == 9
        if request["payload"] == "raise":
            raise OSError("no answer")
        return request["payload"]

    requests = requests.selectExpr("*", "'u' AS base_url", "9 AS timeout_ms")

    got = {r.repo: (r.attempt, r.ok, r.raw) for r in rev.batch_review(requests, ask).collect()}
    assert got == {"fine": (1, True, "{}"), "bad": (3, False, "oops"), "down": (3, False, None)}
