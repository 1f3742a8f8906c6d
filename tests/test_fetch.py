from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from qscore.operators import changes as chg, fetch, review as rev

_KEYS = ("repo", "path")


def _files(spark, n, mark="x"):
    return spark.range(n).select(
        F.concat(F.lit("r"), F.col("id") % 7).alias("repo"),
        F.concat(F.lit("p"), "id", F.lit(".go")).alias("path"),
        F.concat(F.lit(mark), "id", F.repeat(F.lit("\nline"), 20)).alias("content"),
    )


@contextmanager
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("share,most", [(10, fetch._MOST_BLOCKS), (2, fetch._MOST_BLOCKS), (10, 1)])
def test_wanted_rows_all_pass_and_few_others(spark, monkeypatch, share, most):
    monkeypatch.setattr(fetch, "_MOST_BLOCKS", most)
    files = _files(spark, 60_000)
    wanted = files.where(f"pmod(hash(path), {share}) = 0").select(*_KEYS)
    passed = fetch.likely(files, wanted, _KEYS)
    assert passed.columns == files.columns
    assert wanted.join(passed, list(_KEYS), "left_anti").count() == 0
    n, others = wanted.count(), passed.join(wanted, list(_KEYS), "left_anti").count()
    if most > 1:
        assert others < 0.03 * (60_000 - n)
    assert passed.count() == n + others


def test_odd_keys(spark):
    files = spark.createDataFrame([(None, "a", "x"), ("r", None, "x"), ("r", "a", None)], "repo string, path string, content string")
    wanted = spark.createDataFrame([("r", "a"), ("r", "a")], "repo string, path string")
    assert fetch.likely(files, wanted, _KEYS).where("repo = 'r' and path = 'a'").count() == 1
    assert fetch.likely(files, wanted.limit(0), _KEYS).count() == 0
    assert fetch.likely(files.limit(0), wanted, _KEYS).count() == 0
    # Equal values of unlike types have unlike hashes: nothing may be lost.
    longs = spark.range(5).select(F.col("id").alias("k"))
    ints = longs.select(F.col("k").cast("int").alias("k"))
    assert fetch.likely(longs, ints, ("k",)).join(ints, "k").count() == 5


def shuffled_rows(df):
    """Rows that the exchanges of a finished plan wrote, by the columns they hold."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(plan.plan())
            continue
        if name == "Exchange":
            written = plan.metrics().get("shuffleRecordsWritten").get().value()
            columns = [plan.output().apply(i).name() for i in range(plan.output().size())]
            found.append((columns, written))
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_only_content_of_changed_files_is_shuffled(spark):
    files = _files(spark, 20_000)
    changed = files.where("pmod(hash(path), 100) = 0").select(*_KEYS)
    with no_broadcasts(spark):
        wide = [n for columns, n in shuffled_rows(chg.opened(files, changed)) if "content" in columns]
        assert wide and max(wide) < changed.count() + 0.03 * 20_000
        assert chg.opened(files, changed).count() == changed.count()


def test_same_results_without_broadcasts(spark):
    base = _files(spark, 300)
    target = base.withColumn(
        "content", F.when(F.col("path").rlike("7"), "func f() {\n  x := 1\n}\nline").otherwise(F.col("content"))
    )
    changed = chg.snapshot_changes(base, target)

    def results():
        return [
            sorted(map(tuple, df.collect()))
            for df in (
                chg.changed_lines(base, target),
                chg.changed_functions(base, target, changed),
                rev.pack_payload(target, cap=500),
            )
        ]

    with_broadcasts = results()
    with no_broadcasts(spark):
        assert results() == with_broadcasts
    assert len(with_broadcasts[1]) == base.where("path rlike '7'").count()
