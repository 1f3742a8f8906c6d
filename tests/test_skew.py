"""Splitting hot keys must not change a result."""

import pytest
from pyspark.sql import Window, functions as F

from qscore.operators import ranking, skew

HOT = 3000


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows under one key, few under others, and null keys."""
    hot = spark.range(HOT).selectExpr("'hot' AS k", "id", "id % 7 AS v")
    rest = spark.range(2 * HOT).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE 'k' || id % 500 END", "id + 10000", "id % 5")
    return hot.union(rest).cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_few(spark, rows, how):
    few = spark.createDataFrame(
        [("hot", 1), ("k1", 2), ("k1", 3), ("k9", 4), ("absent", 5), (None, 6)], "k string, w int"
    )
    split = skew.join_few(rows, few, "k", spread=("id",), how=how, min_rows=100)
    plain = rows.join(few, "k", how)
    assert split.columns == plain.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_really_split(spark, rows):
    sizes = rows.groupBy("k").count()
    hot = skew.hot_keys(sizes, "count", min_rows=100).collect()
    assert {r.k for r in hot} >= {"hot"}
    assert skew.hot_keys(sizes, "count").count() == 0  # nothing is worth splitting by default


def test_no_more_hot_keys_than_parts(spark):
    sizes = spark.range(50_000).selectExpr("id AS k", "1 + id % 3 AS n")
    assert skew.hot_keys(sizes, "n", min_rows=0).count() < 10_000


def test_first_rows(rows):
    got = skew.first_rows(rows, ["k"], [F.col("v"), F.col("id")], 5, spread=("id",))
    w = Window.partitionBy("k").orderBy("v", "id")
    plain = rows.withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("min_rows", [40, 333, 100_000])
@pytest.mark.parametrize("spacing", ["id", "id * id", "id - id % 400"])
def test_trailing_window(spark, min_rows, spacing):
    """Even, growing and bunched positions; ranges with fewer rows than the window is deep."""
    history = spark.range(900).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 90 = 1 THEN 'b' ELSE 'c' END AS repo",
        f"timestamp_seconds({spacing}) AS ts",
        "id AS event_id",
        "CAST(id * 37 % 201 AS DOUBLE) / 2 AS total",
    )
    measures = {
        "previous": lambda w: F.lag("total").over(w),
        "mean": lambda w: F.avg("total").over(w.rowsBetween(-6, 0)),
    }
    got = skew.trailing_window(history, "repo", ("ts", "event_id"), 6, measures, min_rows=min_rows)
    plain = history
    for name, measure in measures.items():
        plain = plain.withColumn(name, measure(Window.partitionBy("repo").orderBy("ts", "event_id")))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_rank(spark):
    cases = {"critical": (0, "CRITICAL"), "High": (1, "HIGH"), "MEDIUM": (2, "MEDIUM"), "low": (3, "LOW"), "info": (4, "info"), "": (4, "")}
    rows = spark.createDataFrame([("r", p, "x") for p in cases], "repo string, priority string, location string")
    got = {r.priority: (r["rank"], r.label) for r in ranking.ranked(rows).collect()}
    assert got == cases
    assert [r.priority for r in ranking.top_findings(rows).orderBy("position").collect()] == ["critical", "High", "MEDIUM"]


def test_positions(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 50 = 1, 'small', 'hot')) AS k", "id * 7 % 3001 AS v")
    got = {}
    for r in skew.positions(rows.repartition(7), "k", ("v",)).collect():
        got.setdefault(r.k, []).append((r.position, r.v))
    for pairs in got.values():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted(v for _, v in pairs)


def test_trailing_window_cuts_at_quantiles(spark):
    """One far-off position must not leave all others in one range."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).selectExpr("'k' AS k", "if(id = 0, -1000000000L, id) AS at", "id")

    def largest(w):
        return F.count(F.lit(1)).over(w.rowsBetween(-10_000, 10_000))

    out = skew.trailing_window(rows, "k", ("at", "id"), 2, {"n": largest}, min_rows=200)
    assert out.count() == 4000 and out.agg(F.max("n")).first()[0] < 600
