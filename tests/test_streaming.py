from pyspark.sql import functions as F

from qscore.operators import findings as fnd, ranking, scoring
from qscore.shared import fresh_path
from qscore.streaming import detection, trends

FILES = "repo string, path string, content string"


def test_findings_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"r{i % 3}", f"src/f{i}.go", f'func f() {{\n{"{" * (i % 6)}\npassword = "abcd{i}"') for i in range(30)]
    rows += [("r0", "vendor/x.go", 'password = "abcd"'), ("r0", "x.md", 'password = "abcd"')]
    files = spark.createDataFrame(rows, FILES)
    files.repartition(5).write.parquet(src)
    stream = detection.stream_findings(
        spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(src)
    )
    out = fresh_path(spark, "t")
    detection.append_to(stream, out, fresh_path(spark, "t"), once=True).awaitTermination()
    got = spark.read.parquet(out)
    batch = fnd.findings(files.where("path LIKE 'src/%'"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))

    # The files of a repo arrive in several batches; one of them comes again, mended.
    counted, log = fresh_path(spark, "t"), fresh_path(spark, "t")

    def run():
        arrivals = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(src)
        detection.count_batches(arrivals, counted, log, once=True).awaitTermination()
        return sorted(map(tuple, detection.accumulated_scores(spark, counted, repos).collect()))

    repos = spark.createDataFrame([("r0",), ("r1",), ("r2",), ("none",)], "repo string")
    kept = files.where("path LIKE 'src/%'")
    assert run() == sorted(map(tuple, scoring.score(fnd.findings(kept), repos).collect()))
    assert len(list((tmp_path / "in").glob("part-*"))) > 1
    again = spark.createDataFrame([("r2", f"src/f{i}.go", "ok") for i in range(2, 30, 3)], FILES)
    again.coalesce(1).write.mode("append").parquet(src)
    mended = kept.where("repo <> 'r2'").unionByName(again)
    assert run() == sorted(map(tuple, scoring.score(fnd.findings(mended), repos).collect()))


def test_daily_scores_drop_late_reports(spark, tmp_path):
    schema = "repo string, ts timestamp, total double"
    src = str(tmp_path / "in")

    def push(*rows):
        frame = spark.createDataFrame(rows, "repo string, ts string, total double")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    out, log = fresh_path(spark, "t"), fresh_path(spark, "t")

    def run():
        daily = trends.stream_daily_scores(spark.readStream.schema(schema).parquet(src))
        detection.append_to(daily, out, log, once=True).awaitTermination()
        return sorted((r.repo, str(r.day), r.n, r.mean, r.least) for r in spark.read.parquet(out).collect())

    push(("r", "2024-01-01 10:00:00", 80.0), ("r", "2024-01-01 11:00:00", 90.5), ("r", "2024-01-04 00:00:00", 70.0))
    first = run()
    assert first == [("r", "2024-01-01", 2, 85.25, 80.0)]
    push(("r", "2024-01-01 12:00:00", 0.0), ("r", "2024-01-03 12:00:00", 60.0), ("r", "2024-01-09 00:00:00", 50.0))
    assert run() == first + [("r", "2024-01-03", 1, 60.0, 60.0), ("r", "2024-01-04", 1, 70.0, 70.0)]


def test_daily_batch(spark):
    rows = spark.createDataFrame([("r", "2024-01-01 10:00:00", 80.0), ("r", "2024-01-01 11:00:00", 90.5)], "repo string, ts string, total double")
    (got,) = ranking.daily_scores(rows.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert (got.n, got["mean"], got.least) == (2, 85.25, 80.0)
