import json

from pyspark.sql import functions as F

from qscore.operators import findings as fnd, scoring
from qscore.sources import reports as rpt

FILES = [
    ("one", "b/x.go", 'password = "abcd"\nfunc f() {\n{{{{\npassword = "efgh"'),
    ("one", "b-a.go", 'api_key = "12345678"'),
    ("two", "m.go", "ok"),
]


def _inputs(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    found = fnd.findings(files)
    return scoring.score(found, files.select("repo").distinct()), found


def _texts(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.repo, r.n)):
        out[r.repo] = out.get(r.repo, "") + r.text
    return out


def test_json_report(spark):
    scores, found = _inputs(spark)
    got = _texts(rpt.json_lines(scores, found, "2024-01-01T00:00:00Z"))
    two = json.loads(got["two"])
    assert list(two) == ["total", "pillars", "findings", "llm_enhanced", "timestamp"]
    assert list(two["pillars"]) == ["architecture", "security", "static", "verification"]
    assert two["findings"] is None and two["total"] == 100.0 and two["llm_enhanced"] is False
    one = json.loads(got["one"])["findings"]
    # Walk order by segment, secrets before nesting within a file.
    assert [(f["location"], f["line_start"]) for f in one] == [
        ("b/x.go", 1), ("b/x.go", 4), ("b/x.go", 2), ("b-a.go", 1),
    ]
    assert ["severity" in f for f in one] == [True, True, False, True]


def test_reports_hold_absent_fields_as_zeros(spark):
    scores, found = _inputs(spark)
    names = ("priority", "location", "remediation", "description")
    bare = found.limit(1).withColumns({n: F.lit(None).cast("string") for n in names})
    bare = bare.withColumns({"line_start": F.lit(None).cast("int"), "severity": F.lit(None).cast("string")})
    (finding,) = json.loads(_texts(rpt.json_lines(scores, bare, "2024-01-01T00:00:00Z"))["one"])["findings"]
    assert [finding[n] for n in names] == [""] * 4 and finding["line_start"] == 0 and "severity" not in finding
    assert rpt.markdown_lines(scores, bare).where("section = 2 and text is not null").count() == 1


def test_large_reports_come_back_as_one_score(spark, tmp_path):
    rows = spark.range(25_000).selectExpr(
        "'big' AS repo", "'HIGH' AS priority", "'security' AS pillar", "concat('f', id % 5000, '.go') AS location",
        "cast(id AS int) AS line_start", "cast(id AS int) AS line_end", "'d' AS description", "'r' AS remediation",
        "if(id % 2 = 0, 'HIGH', null) AS severity",
    )
    scores = scoring.score(rows, spark.createDataFrame([("big",), ("small",)], "repo string"))
    rpt.write_reports(scores, rows, "2024-01-01T00:00:00Z", str(tmp_path / "out"))
    back, again = rpt.read_reports(spark, str(tmp_path / "out"))
    assert {(r.repo, r.total) for r in back.collect()} == {("big", 80.0), ("small", 100.0)} and back.count() == 2
    assert back.first().timestamp.year == 2024
    got = [(r.location, r.line_start) for r in again.orderBy("place").collect()]
    assert got == sorted((f"f{i % 5000}.go", i) for i in range(25_000))
    assert [r.place for r in again.orderBy("place").select("place").collect()] == list(range(1, 25_001))
    assert again.where("severity is null").count() == 12_500


def test_markdown(spark, tmp_path):
    scores, found = _inputs(spark)
    lines = rpt.markdown_lines(scores, found)
    rpt.write_markdown(lines, str(tmp_path / "md"))

    def text(repo):
        parts = sorted((tmp_path / "md" / f"repo={repo}").glob("part-*"))
        return "".join(p.read_text() for p in parts)

    assert text("two") == (
        "## Quality Report\n\n**Quality Score: 100.0 / 100**\n\n### Pillar Breakdown\n\n"
        "| Pillar | Score |\n| --- | --- |\n| Static Code Health | 20.0 / 20 |\n"
        "| Engineering Architecture | 25.0 / 25 |\n| Dynamic Verification | 35.0 / 35 |\n"
        "| Security & Supply Chain | 20.0 / 20 |\n\nNo findings.\n"
    )
    one = text("one")
    secret = "Move this secret to an environment variable or a secure secrets manager"
    assert one.index("| HIGH | `b-a.go` | 1-1 |") < one.index("| HIGH | `b/x.go` | 1-1 |")
    assert one.index("| HIGH | `b/x.go` | 4-4 |") < one.index("| MEDIUM | `b/x.go` | 2-4 |")
    assert f"### Remediations\n\n- **HIGH** (b-a.go): {secret}\n" in one
    assert one.endswith("reduce complexity\n\n")


def test_findings_without_remediation_have_no_bullet(spark):
    scores, found = _inputs(spark)
    bare = found.withColumn("remediation", F.lit(None).cast("string"))
    assert rpt.markdown_lines(scores, bare).where("section = 4").count() == 0
