import pytest

from qscore.operators import changes as chg, skew
from qscore.plans import corpus, queries
from qscore.sources import commits as cmt

FILES = "repo string, path string, content string"


@pytest.mark.parametrize(
    "path,diff,trivial",
    [
        ("README.md", "", True), ("docs/guide.md", "+x", True), ("LICENSE", None, True),
        ("main.go", "  \n\t\n", True), ("main.go", "　 ", True), ("main.go", "", False),
        ("main.go", None, False), ("main.go", "+func hello() {}", False), ("main.go", " \n+\n ", False),
        ("run.sh", "+x", False),
    ],
)
def test_trivial(spark, path, diff, trivial):
    rows = spark.createDataFrame([("c", path, diff)], "changeset string, path string, diff string")
    got = chg.trivial_changes(rows).first()
    assert got.is_trivial is trivial
    assert got.message == (
        "Changes are trivial (non-code or whitespace-only): " + path if trivial else None
    )


def test_outcomes(spark):
    sets = spark.createDataFrame([("a",), ("b",), ("c",)], "changeset string")
    rows = spark.createDataFrame(
        [("b", "x.md", "+"), ("b", "y.txt", "+"), ("c", "x.md", "+"), ("c", "x.go", "+")],
        "changeset string, path string, diff string",
    )
    got = {r.changeset: (r.outcome, r.exit_code) for r in chg.changeset_outcome(sets, rows).collect()}
    assert got == {"a": ("no_changes", 0), "b": ("trivial", 0), "c": ("scored", None)}
    strict = chg.changeset_outcome(sets, rows, skip_trivial=False)
    assert strict.where("changeset = 'b'").first().outcome == "scored"


def test_snapshots(spark):
    base = spark.createDataFrame([("r", "main.go", "a"), ("r", "old.go", "b"), ("r", "same go", "c")], FILES)
    target = spark.createDataFrame(
        [("r", "main.go", "a\nfunc hello() {}"), ("r", "new.go", ""), ("r", "same go", "c")], FILES
    )
    got = {r.path: r.change_type for r in chg.snapshot_changes(base, target).collect()}
    assert got == {"main.go": "modified", "old.go": "deleted", "new.go": "added"}


def test_range_ignores_what_was_changed_back(spark):
    versions = spark.createDataFrame(
        [
            ("r", "back.go", 1, "a"), ("r", "back.go", 5, "b"), ("r", "back.go", 6, "a"),
            ("r", "kept.go", 1, "a"), ("r", "new.go", 5, "n"), ("r", "gone.go", 1, "g"),
            ("r", "gone.go", 7, None), ("r", "late.go", 9, "l"), ("r", "brief.go", 5, "x"),
            ("r", "brief.go", 6, None),
        ],
        "repo string, path string, seq long, content string",
    )
    ranges = spark.createDataFrame(
        [("a", "r", 2, 8), ("b", "r", 5, 6), ("c", "r", 8, 8), ("d", "r", 6, 9)],
        "range string, repo string, from_seq long, to_seq long",
    )
    got = {}
    for r in chg.range_changes(versions, ranges).collect():
        got.setdefault(r.range, {})[r.path] = r._last.seq
    assert got == {
        "a": {"new.go": 5, "gone.go": 7}, "b": {"back.go": 6, "brief.go": 6}, "d": {"gone.go": 7, "late.go": 9},
    }


def test_changed_lines_are_bags(spark):
    base = spark.createDataFrame([("r", "a.go", "x\nx\ny\nz")], FILES)
    target = spark.createDataFrame([("r", "a.go", "z\nx\nw\nw")], FILES)
    got = {(r.change, r.line, r.copies) for r in chg.changed_lines(base, target).collect()}
    assert got == {("removed", "x", 1), ("removed", "y", 1), ("added", "w", 2)}


def test_commits(spark):
    log = spark.createDataFrame(
        [("r", 1, "abc123 first"), ("r", 2, "def456"), ("r", 3, "  0a1b  two words "), ("r", 4, "XYZ no"), ("r", 5, "ff last")],
        "repo string, seq long, log_line string",
    )
    got = [tuple(r) for r in cmt.commits(log).orderBy("seq").collect()]
    assert got == [("r", 1, "abc123", "first"), ("r", 3, "0a1b", " two words"), ("r", 5, "ff", "last")]
    ranges = spark.createDataFrame([("r", 1, 4)], "repo string, from_seq long, to_seq long")
    assert [r.seq for r in cmt.commits_in_range(log, ranges).collect()] == [3]


def test_changeset_scores(spark):
    target = spark.createDataFrame(
        [("r", "a.go", 'password = "abcd"'), ("r", "vendor/b.go", 'password = "abcd"'), ("r", "c.md", 'password = "abcd"')],
        FILES,
    )
    changes = spark.createDataFrame(
        [("one", "r", "a.go"), ("one", "r", "gone.go"), ("two", "r", "c.md"), ("three", "r", "vendor/b.go")],
        "changeset string, repo string, path string",
    )
    sets = spark.createDataFrame([("one",), ("two",), ("three",), ("none",)], "changeset string")
    got = {r.changeset: r.total for r in chg.changeset_scores(sets, changes, target).collect()}
    assert got == {"one": 80.0, "two": 100.0, "three": 80.0, "none": 100.0}


def test_attribution(spark):
    files = spark.createDataFrame([("r", "a.go", 'x\npassword = "abcd"')], FILES)
    lines = spark.createDataFrame(
        [("r", "a.go", 7, "h7", 'password = "abcd"'), ("r", "a.go", 3, "h3", 'password = "abcd"'), ("r", "b.go", 1, "h1", 'password = "abcd"')],
        "repo string, path string, seq long, hash string, line string",
    )
    (row,) = chg.attribution(files, lines).collect()
    assert (row.line_start, row.seq, row.hash) == (2, 3, "h3")


def test_changed_functions(spark):
    base = spark.createDataFrame([("r", "a.go", "func a\n1\nfunc b\n2")], FILES)
    target = spark.createDataFrame([("r", "a.go", "func a\n1\nfunc b\n3\nfunc c")], FILES)
    got = {(r.line_start, r.code) for r in chg.changed_functions(base, target).collect()}
    assert got == {(3, "func b\n3"), (5, "func c")}


def test_diff_lines(spark):
    rows = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n same")], "id int, diff string")
    got = [r.kind for r in chg.diff_lines(rows, ["id"]).orderBy("line_no").collect()]
    assert got == ["header", "header", "header", "removed", "added", "context"]


def test_versions_of_a_range_move_once(spark, monkeypatch):
    """What met its ranges is aggregated where it lies; a hot repo is spread, with the same result."""
    rows = [(r, f"f{f}.go", s, None if (r + f + s) % 5 == 0 else f"x{(f * s) % 3}") for r in range(3) for f in range(4) for s in range(1, 9)]
    rows = [x for x in rows if x[0] < 2 or x[2] < 3]
    versions = spark.createDataFrame(rows, "repo int, path string, seq long, content string")
    ranges = spark.createDataFrame([(1, 0, 2, 6), (2, 0, 4, 8), (3, 1, 0, 5), (4, 2, 1, 2), (5, 7, 1, 2)], "range int, repo int, from_seq long, to_seq long")
    found = chg.range_changes(versions, ranges)
    assert "hashpartitioning(range" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for key, repo, lo, hi in ranges.collect():
        for f in {x[1] for x in rows}:
            ends = [[x for x in sorted(rows) if x[:2] == (repo, f) and x[2] <= at] for at in (lo, hi)]
            before, after = (e[-1][3] if e else None for e in ends)
            if before != after:
                want.add((key, repo, f, ends[1][-1][2]))
    assert {(r["range"], r.repo, r.path, r._last.seq) for r in found.collect()} == want and len(want) > 5
    monkeypatch.setattr(skew, "_MIN_ROWS", 8)
    assert skew.hot_groups(versions, ("repo",)).count() == 2
    spread = chg.range_changes(versions, ranges)
    assert {(r["range"], r.repo, r.path, r._last.seq) for r in spread.collect()} == want


def test_target_of_pushes_is_made_once(spark, tmp_path):
    lines = spark.range(400).selectExpr(
        "id div 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity", "id * 7 AS l_partkey"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    _, changed, target = queries._pushes(spark, str(tmp_path))
    assert "Aggregate" not in target._jdf.queryExecution().optimizedPlan().toString()
    assert changed.count() and sorted(target.collect()) == sorted(corpus.target_files(spark, str(tmp_path)).collect())
