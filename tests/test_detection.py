import pytest
from pyspark.sql import functions as F

from qscore.functions import code, text
from qscore.operators import findings as fnd, scoring

NESTED = """package main

func deeplyNested() {
	for i := 0; i < 10; i++ {
		if i > 5 {
			for j := 0; j < 5; j++ {
				if j > 2 {
					println(i, j)
				}
			}
		}
	}
}

// end
"""


def _found(files, detectors=fnd.DEFAULT_DETECTORS):
    return [(r.pillar, r.location, r.line_start, r.line_end, r.severity) for r in fnd.findings(files, detectors).collect()]


def test_secret_file(make_files):
    files = make_files(**{"main.go": 'package main\n\nvar apiKey = "sk-1234567890abcdef"\n'})
    assert _found(files) == [("security", "main.go", 3, 3, "HIGH")]


@pytest.mark.parametrize(
    "line,hit",
    [
        ('api_key: "abcdefgh"', 1),
        ('API-KEY = "abcdefgh"', 1),
        ('api_key = "short"', None),
        ("password = 'abcd'", 2),
        ('password := "abcdefgh"', None),
        ('pass == "secret"', None),
        ("task-management1", 3),
        ("sk-abcdefghij", 3),
        ("sk-short", None),
        ("pasſword = 'long s folds'", 2),
        ("sK-abcdefghij", 3),
        ("password\x0b= 'abcdef'", None),
        ('secret = "abc\'', None),
    ],
)
def test_secret_patterns(spark, line, hit):
    row = spark.createDataFrame([(line,)], "l string")
    got = row.select(text.has_secret(F.col("l")), text.secret_pattern(F.col("l"))).first()
    assert tuple(got) == (hit is not None, hit)


def test_one_finding_per_line(make_files):
    files = make_files(**{"a.py": 'password = "abcd"; api_key = "abcdefgh"\r\nsk-abcdefghijk'})
    assert [f[2] for f in _found(files)] == [1, 2]


def test_deep_nesting(spark, make_files):
    files = make_files(**{"deep.go": NESTED})
    (row,) = fnd.findings(files).collect()
    assert (row.line_start, row.line_end) == (3, 16)
    assert row.description == "Function has nesting depth of 4 (max recommended: 3)"
    assert row.severity is None and row.priority == "MEDIUM"
    repos = spark.createDataFrame([("r",)], "repo string")
    assert scoring.score(fnd.findings(files), repos).first().total == 99.0


def test_depth_three_is_fine(make_files):
    body = "func f() {\nif a {\nif b {\nif c {\n}\n}\n}\n}"
    assert _found(make_files(**{"a.go": body})) == []


@pytest.mark.parametrize(
    "lines,expected",
    [
        (["func a() {", "{", "{"], [(1, 3, 2)]),
        (["} } {", "func a()", "}", "{", "func b()", "{ {"], [(2, 4, 1), (5, 6, 2)]),
        (["  def f(): {", "x", "", ""], [(1, 4, 0)]),
        (["func ", "def", "func\tx", "function f() {", "{"], []),
        ([" 　func x", '"{" // {', "fn y {"], [(1, 3, 3)]),
        (["func x", "func y"], [(1, 1, 0), (2, 2, 0)]),
        (["func  \t ", "func  z", "{"], [(2, 3, 1)]),
    ],
)
def test_segments(spark, lines, expected):
    row = spark.createDataFrame([("\n".join(lines),)], "content string")
    seg = row.select(F.inline(text.bind(text.lines_of(F.col("content")), code.segments)))
    got = seg.select("line_start", "line_end", code.max_depth(F.col("body")).alias("d")).collect()
    assert [tuple(r) for r in got] == expected


def test_clamped_depth_is_the_running_formula(spark):
    bodies = ["", "}}{{", "{}{}{{}}", "}{}{{{}}}{{{{", "{{{{}}}}}}}}{"]

    def formula(body):
        p = low = top = 0
        for c in body:
            p += 1 if c == "{" else -1
            low = min(low, p)
            top = max(top, p - low)
        return top

    rows = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in rows.select(code.max_depth(F.col("b"))).collect()]
    assert got == [formula(b) for b in bodies]


def test_lines(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, "x y")], "id int, content string")
    got = fnd.numbered_lines(rows, ["id"]).collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "a\r"), (1, 2, "b"), (1, 3, ""), (2, 1, ""), (3, 1, "x y"),
    ]


def test_poor_names_are_opt_in(make_files):
    files = make_files(**{"a.py": "temp = a + a\ntemperature = data2"})
    assert _found(files) == []
    assert [f[2] for f in _found(files, (fnd.poor_names,))] == [1, 1, 2]


def test_complexity(spark):
    row = spark.createDataFrame([("if a && b {\nfor x || y\nswitch\ncase 1:\nelseif",)], "b string")
    assert row.select(code.complexity(F.col("b"))).first()[0] == 6


def test_diff_secrets(spark):
    diff = '+++ b/password = "abcd"\n-password = "gone"\n password = "kept"\n+password = "added"\n+ok'
    rows = spark.createDataFrame([(1, diff)], "id int, diff string")
    got = fnd.diff_secrets(rows, ["id"]).collect()
    assert len(got) == 2 and (got[0].location, got[0].line_start, got[0].line_end) == ("", 0, 0)


def test_partition_independence(spark, make_files):
    files = make_files(**{f"d{i}/f.go": NESTED + f'password = "abcd{i}"' for i in range(20)})
    repos = spark.createDataFrame([("r",)], "repo string")
    results = {
        n: scoring.score(fnd.findings(files.repartition(n)), repos).collect() for n in (1, 8, 64)
    }
    assert results[1] == results[8] == results[64]


def test_truncate(spark):
    rows = spark.createDataFrame([("short",), ("exactly-10",), ("more than ten",)], "s string")
    got = [r[0] for r in rows.select(text.truncate(F.col("s"), 10)).collect()]
    assert got == ["short", "exactly-10", "more th..."]
    texts = ["é" * 40, "a" + "é" * 40, "日本語テキスト" * 4, "😀" * 9, "ab😀" * 5, "é" * 10]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for size in (4, 5, 6, 7, 12, 20):
        for t, r in zip(texts, rows.select(text.truncate(F.col("s"), size)).collect()):
            raw = t.encode()
            want = t if len(raw) <= size else raw[: size - 3].decode(errors="ignore") + "..."
            assert r[0] == want and len(r[0].encode()) <= max(size, len(raw) * (len(raw) <= size))


def test_number_text(spark):
    rows = spark.createDataFrame([(72.25,), (72.5,), (100.0,), (0.75,), (-1.25,)], "x double")
    got = [r[0] for r in rows.select(text.number_text(F.col("x"), 1)).collect()]
    assert got == ["72.2", "72.5", "100.0", "0.8", "-1.2"]
