import json

from qscore.plans import flows
from qscore.sources import policies as pol

FILES = "repo string, path string, content string"
SECRET = 'package main\n\nvar secret = "sk-1234567890abcdef"\n'


def _policies(spark, **gates):
    rows = [(org, json.dumps(doc)) for org, doc in gates.items()]
    return pol.flatten(spark.createDataFrame(rows, "org string, raw string"))


def test_workspaces(spark):
    clean = {"main.go": "package main", "auth/auth.go": 'if pass == "secret" {}', "README.md": SECRET}
    trees = {
        "clean": clean,
        "secret": {**clean, "bad.go": SECRET},
        "vendored": {"vendor/bad.go": SECRET, "docs/guide.md": "func x"},
        "kept": {"vendor/bad.go": SECRET},
        "broken": clean,
    }
    files = spark.createDataFrame([(r, p, c) for r, t in trees.items() for p, c in t.items()], FILES)
    owners = {"clean": "strict", "secret": "strict", "vendored": "strict", "kept": "lax", "broken": "bad", "empty": "strict"}
    repos = spark.createDataFrame(list(owners.items()), "repo string, org string")
    policies = _policies(
        spark,
        strict={"gate": {"target_threshold": 99, "llm": {"base_url": "u"}}, "exclusions": {"paths": ["**/vendor/**"]}},
        lax={
            "gate": {"fail_on_critical_security": True, "llm": {"base_url": "u"},
                     "privacy": {"allow_public_cloud_transmission": False}}
        },
        bad={"gate": {"target_threshold": 150}},
    )
    got = {r.repo: (r.total, r.exit_code) for r in flows.check_workspaces(files, repos, policies).collect()}
    assert got == {
        "clean": (100.0, 0), "secret": (80.0, 2), "vendored": (100.0, 0), "kept": (80.0, 0),
        "broken": (100.0, 1), "empty": (100.0, 0),
    }
    hard = flows.check_workspaces(files, repos, policies, hard_fail=True)
    assert hard.where("repo = 'kept'").first().exit_code == 2
    answers = spark.createDataFrame([("clean", 5.0, 2.5), ("kept", 5.0, 2.5)], "repo string, static_deduction double, architecture_deduction double")
    reviewed = {r.repo: r for r in flows.check_workspaces(files, repos, policies, answers).collect()}
    assert (reviewed["clean"].total, reviewed["clean"].exit_code, reviewed["clean"].llm_enhanced) == (92.5, 2, True)
    assert reviewed["secret"].llm_enhanced is False
    # Nothing of an organisation behind an air gap has been sent, so nothing comes back.
    assert (reviewed["kept"].total, reviewed["kept"].llm_enhanced) == (80.0, False)
    found = flows.workspace_findings(files, repos, policies)
    assert {(r.repo, r.location) for r in found.collect()} == {("secret", "bad.go"), ("kept", "vendor/bad.go")}
    scores = flows.scr.score(found, repos, blocking=True)
    blocking = flows.gt.blocking_findings(scores, found, policies)
    assert [(r.repo, r.location) for r in blocking.collect()] == [("kept", "vendor/bad.go")]


def test_policies_that_cannot_be_read_are_errors(spark):
    policies = pol.flatten(
        spark.createDataFrame([("cut", '{"gate": {"target'), ("odd", '{"exclusions": {"paths": [1]}}')], "org string, raw string")
    )
    target = spark.createDataFrame([("r", "b.go", "ok")], FILES)
    sets = spark.createDataFrame([(f"{o} {k}", o) for o in ("cut", "odd", "none") for k in "ab"], "changeset string, org string")
    changes = spark.createDataFrame(
        [(f"{o} a", "r", "b.go", "+x") for o in ("cut", "odd", "none")], "changeset string, repo string, path string, diff string"
    )
    got = flows.check_changesets(sets, changes, target, policies).collect()
    assert len(got) == 6 and all(r.exit_code == 1 and r.total is None for r in got)


def test_ranges(spark):
    versions = spark.createDataFrame(
        [("r", "a.go", 1, "ok"), ("r", "a.go", 2, SECRET), ("r", "a.go", 4, "fine"), ("r", "b.md", 3, "x"), ("r", "c.go", 4, None)],
        "repo string, path string, seq long, content string",
    )
    rows = [("bad", 1, 2), ("good", 2, 4), ("same", 4, 4), ("docs", 2, 3), ("wide", 0, 3)]
    ranges = spark.createDataFrame([(k, "o", "r", lo, hi) for k, lo, hi in rows], "range string, org string, repo string, from_seq long, to_seq long")
    policies = _policies(spark, o={"gate": {"target_threshold": 95, "llm": {"base_url": "u"}}})
    answers = spark.createDataFrame([("good", 5.0, 2.5)], "range string, static_deduction double, architecture_deduction double")
    got = {r.range: (r.n_changes, r.outcome, r.total, r.exit_code) for r in flows.check_ranges(ranges, versions, policies, evaluations=answers).collect()}
    assert got == {
        "bad": (1, "scored", 80.0, 2), "good": (2, "scored", 92.5, 2), "same": (0, "no_changes", None, 0),
        "docs": (1, "scored", 100.0, 0), "wide": (2, "scored", 80.0, 2),
    }


def test_changesets(spark):
    target = spark.createDataFrame([("r", "a.go", SECRET), ("r", "b.go", "ok"), ("r", "vendor/c.go", SECRET)], FILES)
    changes = spark.createDataFrame(
        [
            ("docs", "r", "README.md", "+x"), ("bad", "r", "a.go", "+x"), ("bad", "r", "README.md", "+x"),
            ("fine", "r", "b.go", "+x"), ("vendored", "r", "vendor/c.go", "+x"), ("space", "r", "a.go", " \n"),
        ],
        "changeset string, repo string, path string, diff string",
    )
    names = ["docs", "bad", "fine", "vendored", "space", "none"]
    sets = spark.createDataFrame([(n, "o") for n in names] + [("unowned", "x")], "changeset string, org string")
    policies = _policies(spark, o={"gate": {"target_threshold": 90}})
    got = {r.changeset: (r.outcome, r.total, r.exit_code) for r in flows.check_changesets(sets, changes, target, policies).collect()}
    assert got == {
        "docs": ("trivial", None, 0), "bad": ("scored", 80.0, 2), "fine": ("scored", 100.0, 0),
        "vendored": ("scored", 80.0, 2), "space": ("trivial", None, 0), "none": ("no_changes", None, 0),
        "unowned": ("no_changes", None, 1),
    }
    ranges = flows.check_changesets(sets, changes, target, policies, skip_trivial=False)
    got = {r.changeset: (r.outcome, r.exit_code) for r in ranges.collect()}
    assert got["docs"] == ("scored", 0) and got["space"] == ("scored", 2)
