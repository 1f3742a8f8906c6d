"""Bulk reviews that go on where they stopped, and requests of change sets."""

import glob
import json
import os

import pytest

from qscore import constants as K
from qscore.operators import changes as chg, review as rev

REQUESTS = "repo string, base_url string, model_name string, temperature double, timeout_ms int, system_prompt string, payload string"


def _requests(spark, n, parts=1):
    rows = [(f"r{i}", "u", "m", 0.5, 10, "p", f"code {i}") for i in range(n)]
    return spark.createDataFrame(rows, REQUESTS).repartition(parts, "repo")


def _counted(folder, fails_at=None):
    """A model that notes each question in a file of its own, and dies with its task at one of them, once."""

    def ask(request):
        import os
        import uuid

        name = request["payload"].replace(" ", "-")
        with open(f"{folder}/{name}.{uuid.uuid4().hex}", "w"):
            pass
        if name == fails_at and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        return json.dumps({"pillar_adjustments": {"static_health_deduction": int(name.split("-")[1])}})

    return ask


def _asked(folder):
    names = [os.path.basename(p).split(".")[0] for p in glob.glob(f"{folder}/code-*")]
    return {n: names.count(n) for n in names}


def test_task_that_dies_asks_nothing_twice(spark, tmp_path):
    """The worker dies at one question; local masters don't try tasks again, so the run is started again."""
    asked, journal = tmp_path / "asked", str(tmp_path / "journal")
    asked.mkdir()
    requests = _requests(spark, 30)
    ask = _counted(str(asked), fails_at="code-17")
    with pytest.raises(Exception):
        rev.batch_review(requests, ask, at_once=1, journal=journal).collect()
    before = _asked(asked)
    assert 1 < len(before) < 30
    got = {r.repo: (r.attempt, json.loads(r.raw)["pillar_adjustments"]["static_health_deduction"], r.ok)
           for r in rev.batch_review(requests, ask, at_once=4, journal=journal).collect()}
    assert got == {f"r{i}": (1, i, True) for i in range(30)}
    assert _asked(asked) == {f"code-{i}": 2 if i == 17 else 1 for i in range(30)}


def test_only_usable_answers_stay(spark, tmp_path):
    journal = str(tmp_path / "journal")

    def poor(request):
        if request["payload"] == "code 0":
            return "sorry"
        if request["payload"] == "code 1":
            raise TimeoutError
        return "{}"

    first = {r.repo: tuple(r)[1:] for r in rev.batch_review(_requests(spark, 4), poor, journal=journal).collect()}
    assert first == {"r0": (3, "sorry", False), "r1": (3, None, False), "r2": (1, "{}", True), "r3": (1, "{}", True)}
    better = lambda request: '{"remediations": []}'
    again = {r.repo: r.raw for r in rev.batch_review(_requests(spark, 4, 2), better, journal=f"file://{journal}").collect()}
    assert again == {"r0": '{"remediations": []}', "r1": '{"remediations": []}', "r2": "{}", "r3": "{}"}
    # Another model is another question.
    other = _requests(spark, 4).replace("m", "other", ["model_name"])
    assert {r.raw for r in rev.batch_review(other, better, journal=journal).collect()} == {'{"remediations": []}'}
    assert not [p for p in glob.glob(f"{journal}/*/*") if not p.endswith(".json")]


def test_first_answer_stays(tmp_path):
    book = rev.Journal(f"file:{tmp_path}/j")
    assert book.find("ab") is None
    assert book.keep("ab", 2, "é\n") == (2, "é\n") and book.keep("ab", 1, "later") == (2, "é\n")
    assert rev.Journal(f"{tmp_path}/j").find("ab") == (2, "é\n")


def test_pause_between_attempts(monkeypatch):
    slept = []
    monkeypatch.setattr(rev.time, "sleep", slept.append)
    assert rev._ask(lambda r: "no", {}, 4, 0.5) == (4, "no", False) and slept == [0.5, 1.0, 2.0]
    slept.clear()
    assert rev._ask(lambda r: "{}", {}, 4, 0.5) == (1, "{}", True) and not slept


FILES = "repo string, path string, content string"
POLICY = "org string, base_url string, allow_public_cloud_transmission boolean, model_name string, temperature double, timeout_ms int, data_scrubbing boolean, exclusion_paths array<string>"


def test_requests_hold_changed_functions_only(spark):
    base = {"a.go": "top\nfunc a\n1\nfunc b\n2", "x/v.go": "func v\n1", "same.go": "func s\n1", "n.md": "func m\n1"}
    target = {"a.go": "TOP\nfunc a\n1\nfunc b\npassword = \"abcd\"", "x/v.go": "func v\n2", "same.go": "func s\n1",
              "n.md": "func m\n2", "b.go": "func new\n9", "plain.go": "no function"}
    old, new = (spark.createDataFrame([(r, p, c) for p, c in files.items() for r in ("r", "q")], FILES) for files in (base, target))
    changed = chg.snapshot_changes(old, new)
    segments = chg.changed_functions(old, new, changed).cache()
    changes = changed.where("repo = 'r'").selectExpr("'one' AS changeset", "repo", "path").unionByName(
        changed.selectExpr("'two' AS changeset", "repo", "path")).unionByName(
        changed.selectExpr("'mute' AS changeset", "repo", "path"))
    sets = spark.createDataFrame([("one", "o"), ("two", "p"), ("mute", "shut"), ("none", "o")], "changeset string, org string")
    policies = spark.createDataFrame(
        [("o", "u", None, "m", 0.0, 0, None, ["x/**"]), ("p", "u", True, "m", 0.0, 7, False, []), ("shut", "u", False, "m", 0.0, 0, None, [])], POLICY
    )
    got = {r.changeset: r for r in rev.changeset_requests(segments, changes, sets, policies).collect()}
    assert set(got) == {"one", "two"}
    assert got["one"].segments == ["r/a.go:4-5", "r/b.go:1-2"] and got["one"].timeout_ms == K.REVIEW_TIMEOUT_MS
    assert got["one"].payload == f"=== r/a.go:4-5 ===\nfunc b\n{K.REDACTED}\n=== r/b.go:1-2 ===\nfunc new\n9"
    assert got["two"].segments == [f"{r}/{s}" for r in ("q", "r") for s in ("a.go:4-5", "b.go:1-2", "x/v.go:1-2")]
    assert 'password = "abcd"' in got["two"].payload and got["two"].timeout_ms == 7


def test_segments_name_only_what_was_sent(spark):
    long = "x" * 20_000
    segments = spark.createDataFrame([("r", f"f{i}.go", 1, 2, f"func f{i}\n{long}") for i in range(3)], "repo string, path string, line_start int, line_end int, code string")
    changes = segments.selectExpr("1 AS changeset", "repo", "path")
    sets = spark.createDataFrame([(1, "o")], "changeset int, org string")
    policies = spark.createDataFrame([("o", "u", None, "m", 0.0, 0, None, None)], POLICY)
    (row,) = rev.changeset_requests(segments, changes, sets, policies).collect()
    assert row.segments == ["r/f0.go:1-2"] and "f1" not in row.payload and "[truncated" in row.payload
