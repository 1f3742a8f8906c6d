"""Lives of lines against a plain walk through the versions."""

import random
from collections import Counter

import pytest

from qscore.operators import lineage, skew

RNG = random.Random(5)
VERSIONS = "repo string, path string, seq long, part int, content string"


def _histories():
    rows = []
    for repo in ("a", "b"):
        for f in range(6):
            seq = 0
            for _ in range(RNG.randrange(1, 25)):
                seq += RNG.randrange(3)
                lines = RNG.choices(["}", "", "x = 1", 'password = "abcd"', "\r"], k=RNG.randrange(1, 7))
                content = RNG.choice([None, "\n".join(lines), "\n".join(lines), "\n".join(lines)])
                rows.append((repo, f"f{f}", seq, len(rows), content))
    return rows


def _lives(rows):
    """(repo, path, line, copy) -> [born, gone] of each life, as version numbers; and the versions of each file."""
    files = {}
    for r in sorted(rows, key=lambda r: r[:4]):
        files.setdefault(r[:2], []).append(r)
    lives = {}
    for file, versions in files.items():
        before = Counter()
        for v, r in enumerate(versions, 1):
            now = Counter([] if r[4] is None else r[4].split("\n"))
            for line in before | now:
                for copy in range(before[line] + 1, now[line] + 1):
                    lives.setdefault((*file, line, copy), []).append([v, None])
                for copy in range(now[line] + 1, before[line] + 1):
                    lives[(*file, line, copy)][-1][1] = v
            before = now
    return lives, files


@pytest.fixture(scope="module")
def history(spark):
    rows = _histories()
    # Rows without a place in the order are no versions.
    frame = spark.createDataFrame([*rows, ("a", "f0", None, 1, "lost"), ("a", None, 1, 1, "lost")], VERSIONS)
    copies = lineage.copy_events(lineage.line_events(frame, ("seq", "part"))).cache()
    return rows, copies


def test_intervals(history):
    rows, copies = history
    lives, _ = _lives(rows)
    want = sorted((*k, *life) for k, many in lives.items() for life in many)
    got = [tuple(r) for r in lineage.line_intervals(copies).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(len(many) > 1 for many in lives.values())


def test_living_as_of_targets(spark, history):
    rows, copies = history
    asked = [(1, "a", 0), (2, "a", 9), (3, "b", 9), (4, "b", 10**6), (5, "none", 3), (6, "a", None)]
    targets = spark.createDataFrame(asked, "target int, repo string, at long")
    want = set()
    for key, repo, at in asked:
        if at is None:
            continue
        lives, files = _lives([r for r in rows if r[0] == repo and r[2] <= at])
        for copy, many in lives.items():
            if many[-1][1] is None:
                version = many[-1][0]
                want.add((key, *copy, version, *files[copy[:2]][version - 1][2:4]))
    got = [tuple(r) for r in lineage.living_lines(copies, targets, ("seq", "part")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_line_put_back_is_the_later_commits(spark):
    secret = 'password = "abcd"'
    rows = [(1, f"{secret}\na"), (2, "a"), (3, f"a\n{secret}"), (4, f"{secret}\na\n{secret}"), (5, f"a\n{secret}\n{secret}\nb")]
    frame = spark.createDataFrame([("r", "f.go", s, c) for s, c in rows], "repo string, path string, seq long, content string")
    copies = lineage.copy_events(lineage.line_events(frame))
    files = frame.where("seq = 5").unionByName(frame.where("seq = 1").selectExpr("repo", "'new.go' AS path", "seq", "content"))
    got = lineage.living_attribution(files, lineage.living_lines(copies)).collect()
    assert sorted((r.path, r.line_start, r.seq) for r in got) == [("f.go", 2, 3), ("f.go", 3, 4), ("new.go", 1, None)]


def test_no_versions(spark):
    copies = lineage.copy_events(lineage.line_events(spark.createDataFrame([], VERSIONS), ("seq", "part")))
    assert lineage.line_intervals(copies).count() == 0
    assert lineage.living_lines(copies, order=("seq", "part")).count() == 0


def test_running_sum_over_ranges(spark):
    rows = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, if(id % 50 = 1, 'small', 'hot')) AS k", "id * 7 % 3001 AS at", "id % 11 - 5 AS v"
    )
    out = skew.running_sum(rows.repartition(5), ("k",), ("at",), "v", "s").collect()
    sums = Counter()
    for r in sorted(out, key=lambda r: (str(r.k), r.at)):
        sums[r.k] += r.v
        assert r.s == sums[r.k]
    assert len(out) == 3000


def test_small_files_are_not_sorted_over_ranges(spark, history, monkeypatch):
    """Ranges, which cost several passes, are for hot keys only."""

    def ranged(*args, **kwargs):
        raise AssertionError("no key is hot")

    monkeypatch.setattr(lineage, "positions", ranged)
    monkeypatch.setattr(skew, "positions", ranged)
    rows, _ = history
    copies = lineage.copy_events(lineage.line_events(spark.createDataFrame(rows, VERSIONS), ("seq", "part"))).cache()
    lives, _ = _lives(rows)
    assert lineage.line_intervals(copies).count() == sum(map(len, lives.values()))


def test_hot_files_have_the_same_lives(spark, history, monkeypatch):
    """With some files, lines and copies hot, and the others not."""
    rows, copies = history
    want = sorted(map(tuple, lineage.line_intervals(copies).collect()))
    living = sorted(map(tuple, lineage.living_lines(copies, order=("seq", "part")).collect()))
    monkeypatch.setattr(skew, "_MIN_ROWS", 8)
    frame = spark.createDataFrame(rows, VERSIONS)
    assert 0 < skew.hot_groups(frame, ("repo", "path")).count() < frame.select("repo", "path").distinct().count()
    hot = lineage.copy_events(lineage.line_events(frame, ("seq", "part"))).cache()
    assert skew.hot_groups(hot, ("repo", "path", "line", "copy")) is not None
    assert sorted(map(tuple, lineage.line_intervals(hot).collect())) == want
    assert sorted(map(tuple, lineage.living_lines(hot, order=("seq", "part")).collect())) == living
