"""Commit graphs against sets of ancestors."""

import random

import pytest

from qscore.operators import history

PARENTS = "repo string, commit string, nth int, parent string"


def _graph(spark, commits):
    """``commits``: {(repo, commit): [parents]}"""
    rows = [(r, c, n, p) for (r, c), ps in commits.items() for n, p in enumerate(ps or [None])]
    return history.graph(spark.createDataFrame(rows, PARENTS))


def _ancestors(commits, repo, commit):
    seen, todo = set(), [commit]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += commits.get((repo, c), [])
    return seen


def _random(seed, n):
    """Branches, merges of two and three, several roots, in two repos that share the names of commits."""
    rng = random.Random(seed)
    commits = {}
    for repo in ("a", "b"):
        for i in range(n):
            some = [] if i == 0 or rng.random() < 0.04 else rng.sample(range(max(0, i - 9), i), min(i, rng.choice([1, 1, 1, 1, 2, 2, 3])))
            commits[repo, f"c{i:03}"] = [f"c{p:03}" for p in some]
    return commits


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 120)])
def test_ranges_and_merge_bases_are_those_of_sets(spark, seed, n):
    commits, rng = _random(seed, n), random.Random(seed)
    of = _graph(spark, commits)
    pairs = [(i, rng.choice("ab"), f"c{rng.randrange(n):03}", f"c{rng.randrange(n):03}") for i in range(80)]
    df = spark.createDataFrame(pairs, "id int, repo string, base string, target string")
    tips = df.selectExpr("id", "repo", "target AS commit")
    got, ranges, bases = {}, {}, {}
    for out, found in (
        (got, history.reachable(of, tips)),
        (ranges, history.reachable(of, tips, df.selectExpr("id", "repo", "base AS commit"))),
        (bases, history.merge_bases(of, df)),
    ):
        rows = found.collect()
        for r in rows:
            out.setdefault(r.id, set()).add(r.commit)
        assert len(rows) == sum(map(len, out.values()))
    several = 0
    for i, repo, a, b in pairs:
        old, new = _ancestors(commits, repo, a), _ancestors(commits, repo, b)
        assert got[i] == new and ranges.get(i, set()) == new - old
        common = old & new
        best = {c for c in common if not any(c != d and c in _ancestors(commits, repo, d) for d in common)}
        assert bases.get(i, set()) == best
        several += len(best) > 1
    assert several


def test_places_follow_first_parents(spark):
    commits = {("r", f"c{i:02}"): [f"c{i - 1:02}"] if i else [] for i in range(40)}
    commits["r", "d1"], commits["r", "d2"] = ["c10"], ["d1", "c20"]
    of = _graph(spark, commits)
    places = {r.commit: (r.chain, r.pos) for r in of.places.collect()}
    assert all(places[f"c{i:02}"] == ("c00", i) for i in range(40))
    assert places["d1"] == ("d1", 0) and places["d2"] == ("d1", 1)
    links = {(r.chain, r.pos, r.to_chain, r.to_pos) for r in of.links.collect()}
    assert links == {("d1", 0, "c00", 10), ("d1", 1, "c00", 20)}


def test_odd_graphs(spark):
    commits = {("r", "b"): ["a"], ("r", "c"): ["b", "x"], ("s", "b"): []}  # a and x are not in the table
    of = _graph(spark, commits)
    one = "id int, repo string, commit string"
    found = history.reachable(of, spark.createDataFrame([(1, "r", "c"), (2, "s", "b"), (3, "r", "none"), (2, "r", "a")], one))
    assert sorted((r.id, r.repo, r.commit) for r in found.collect()) == [
        (1, "r", "a"), (1, "r", "b"), (1, "r", "c"), (1, "r", "x"), (2, "r", "a"), (2, "s", "b"),
    ]
    pairs = spark.createDataFrame([(1, "r", "x", "b"), (2, "r", "c", "c"), (3, "r", "c", "x")], "id int, repo string, base string, target string")
    assert sorted((r.id, r.commit) for r in history.merge_bases(of, pairs).collect()) == [(2, "c"), (3, "x")]
    none = history.graph(spark.createDataFrame([], PARENTS))
    assert history.merge_bases(none, pairs).count() == 0 and none.places.count() == 0
    crossed = _graph(spark, {("r", "a"): [], ("r", "b"): ["a"], ("r", "c"): ["a"], ("r", "d"): ["b", "c"], ("r", "e"): ["c", "b"]})
    pair = spark.createDataFrame([(1, "r", "d", "e")], "id int, repo string, base string, target string")
    assert sorted(r.commit for r in history.merge_bases(crossed, pair).collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        _graph(spark, {("r", "a"): ["b"], ("r", "b"): ["a"]})


def test_no_table_of_commits_is_broadcast(spark):
    """Tables as long as the history may be small on disk: none of them goes through the driver."""
    commits, rng = _random(3, 40), random.Random(3)
    of = _graph(spark, commits)
    pairs = [(i, "a", f"c{rng.randrange(40):03}", f"c{rng.randrange(40):03}") for i in range(9)]
    df = spark.createDataFrame(pairs, "id int, repo string, base string, target string")
    tips, less = (df.selectExpr("id", "repo", f"{c} AS commit") for c in ("target", "base"))
    for found in (history.merge_bases(of, df), history.reachable(of, tips, less)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
