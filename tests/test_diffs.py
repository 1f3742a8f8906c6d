"""Diffs of lines: what they change back and forth, their size, and their form."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from qscore.operators import changes, diffs

RNG = random.Random(17)


def _edited(lines, edits):
    out = list(lines)
    for _ in range(edits):
        at, kind = RNG.randrange(len(out) + 1), RNG.randrange(4)
        if kind == 0:
            out[at:at] = [RNG.choice(["new", "}", "", f"line {RNG.randrange(50)}"])]
        elif kind == 1:
            out[at : at + RNG.randrange(4)] = []
        elif kind == 2:
            out[at : at + 1] = ["changed"]
        else:
            part = out[at : at + 3]
            out[at : at + 3] = []
            to = RNG.randrange(len(out) + 1)
            out[to:to] = part
    return out


def _cases():
    for n in (0, 1, 2, 8, 40, 200):
        for kinds in (2, 12, 10**6):
            base = [f"line {RNG.randrange(kinds)}" for _ in range(n)]
            for edits in (0, 1, 3, 12):
                yield base, _edited(base, edits)


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_turn_one_version_into_the_other(context):
    for a, b in _cases():
        parts = diffs.hunks(a, b, context)
        assert diffs.patched(a, [(p[0], p[1], p[4]) for p in parts]) == b
        assert (parts == []) == (a == b)
        for old, olds, new, news, body in parts:
            lines = body.split("\n")
            assert a[old - (olds > 0) :][:olds] == [x[1:] for x in lines if x[0] != "+"]
            assert b[new - (news > 0) :][:news] == [x[1:] for x in lines if x[0] != "-"]


def test_anchors_rise_and_are_equal_lines():
    for a, b in _cases():
        found = diffs.aligned(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_distinct_lines_are_aligned_as_far_as_can_be():
    """Without repeated lines, what stays is a longest common subsequence."""
    for n in (5, 30):
        for _ in range(40):
            a = RNG.sample(range(60), n)
            b = RNG.sample(range(60), n)
            best = [[0] * (n + 1) for _ in range(n + 1)]
            for i in range(n):
                for j in range(n):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            common = set(a) & set(b)
            found = diffs.aligned([str(x) for x in a], [str(x) for x in b])
            assert len(found) <= best[n][n] and (not common or found)
            assert len(diffs._in_order([(i, b.index(x)) for i, x in enumerate(a) if x in common])) == best[n][n]


def test_form_is_that_of_unified_diffs():
    a = [f"l{i}" for i in range(40)]
    b = a[:5] + ["x"] + a[5:20] + a[22:39] + ["last"]
    want = [x for x in difflib.unified_diff(a, b, lineterm="")][2:]
    got = []
    for old, olds, new, news, body in diffs.hunks(a, b):
        got += [f"@@ -{old},{olds} +{new},{news} @@", *body.split("\n")]
    assert got == want


def test_patch_of_another_text_is_refused():
    parts = [(p[0], p[1], p[4]) for p in diffs.hunks(["a", "b"], ["a", "c"])]
    assert diffs.patched(["a", "z"], parts) is None and diffs.patched([], parts) is None


def _files(spark, contents):
    return spark.createDataFrame([("r", p, c) for p, c in contents.items()], "repo string, path string, content string")


BASE = {"same": "a\nb", "edit": "a\nb\nc\n", "gone": "x\ny", "empty": "", "crlf": "a\r\nb\r\n", "was": "-- dashes\n++ pluses", "none": None, "gone empty": ""}
TARGET = {"same": "a\nb", "edit": "a\nB\nc", "new": "p\n\nq\n", "empty": "now", "crlf": "a\nb\n", "was": "++ pluses\n-- dashes\n- x", "none": "some", "new empty": ""}


def test_files_of_two_snapshots(spark):
    base, target = _files(spark, BASE), _files(spark, TARGET)
    changed = changes.snapshot_changes(base.where("content is not null"), target)
    made = diffs.unified_diffs(base, target, changed).cache()
    kinds = {r.path: r.change_type for r in made.collect()}
    assert kinds == {
        "edit": "modified", "gone": "deleted", "new": "added", "empty": "modified", "crlf": "modified", "was": "modified",
        "none": "added", "new empty": "added", "gone empty": "deleted",
    }
    after = {r.path: r.content for r in diffs.apply_diffs(base, made).collect()}
    assert after == {p: c for p, c in TARGET.items() if p in kinds}
    wrong = diffs.apply_diffs(_files(spark, {"edit": "other"}), made.where("path = 'edit'")).first()
    assert wrong.content is None
    back = diffs.apply_diffs(target, diffs.unified_diffs(target, base, changes.snapshot_changes(target, base.where("content is not null"))))
    assert {r.path: r.content for r in back.collect()} == {p: c for p, c in BASE.items() if p in kinds and c is not None}


def test_texts_and_lines_of_diffs(spark):
    base, target = _files(spark, BASE), _files(spark, TARGET)
    made = diffs.unified_diffs(base, target, changes.snapshot_changes(base.where("content is not null"), target))
    texts = {r.path: r.diff for r in diffs.diff_texts(made).collect()}
    assert texts["edit"] == "--- a/edit\n+++ b/edit\n@@ -1,4 +1,3 @@\n a\n-b\n+B\n c\n-"
    assert texts["gone"].startswith("--- a/gone\n+++ /dev/null\n@@ -1,2 +0,0 @@") and texts["new"].startswith("--- /dev/null\n+++ b/new\n@@ -0,0 +1,4 @@")
    lines = diffs.line_changes(made)
    got = {(r.path, r.change, r.line_no, r.line) for r in lines.where("path in ('edit', 'was')").collect()}
    assert {x for x in got if x[0] == "edit"} == {("edit", "added", 2, "B"), ("edit", "removed", 2, "b"), ("edit", "removed", 4, "")}
    for path, change, at, line in got:
        assert (TARGET if change == "added" else BASE)[path].split("\n")[at - 1] == line
    # The lines that stay are those of the bags, so additions less removals agree for every file.
    sign = F.when(F.col("change") == "added", 1).otherwise(-1)
    net = {r.path: r.n for r in lines.groupBy("path").agg(F.sum(sign).alias("n")).collect()}
    assert net == {p: len(TARGET[p].split("\n") if p in TARGET else []) - len((BASE.get(p) or "").split("\n") if BASE.get(p) is not None else []) for p in net}


def test_no_changes(spark):
    base = _files(spark, {"same": "a"})
    assert diffs.unified_diffs(base, base, changes.snapshot_changes(base, base)).count() == 0
