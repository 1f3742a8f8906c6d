"""Reports: JSON and Markdown out, JSON back in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from qscore import constants as K, schemas
from qscore.functions.paths import walk_order
from qscore.functions.text import number_text
from qscore.operators.ranking import rank
from qscore.operators.scoring import PILLARS
from qscore.operators.skew import positions

_FIELDS = ("priority", "pillar", "location", "line_start", "line_end", "description", "remediation", "severity")


def _complete(findings: DataFrame) -> DataFrame:
    """Absent texts are empty and absent numbers 0; only a severity may be absent."""
    kinds = dict(findings.dtypes)
    return findings.withColumns(
        {
            c: F.coalesce(c, F.lit(0 if kinds[c] in ("int", "bigint") else "").cast(kinds[c]))
            for c in _FIELDS
            if c != "severity"
        }
    )


def _discovered(findings: DataFrame) -> DataFrame:
    """Findings with their place in the order of discovery: file walk, secrets before nesting, line."""
    order = {
        "_walk": walk_order(F.col("location")),
        "_kind": F.col("pillar") != K.SECURITY,
        "_line": F.col("line_start"),
        "_rest": F.struct(*[F.col(c) for c in _FIELDS]),
    }
    return positions(_complete(findings).withColumns(order), "repo", tuple(order), "place").drop(*order)


def _head(scores: DataFrame, run_ts: str) -> tuple[Column, Column]:
    """JSON of what stands before the findings of a report and of what stands behind them."""
    enhanced = F.col("llm_enhanced") if "llm_enhanced" in scores.columns else F.lit(False)
    pillars = F.create_map(*[c for p in sorted(PILLARS) for c in (F.lit(p), F.col(p))])
    front = F.to_json(F.struct("total", pillars.alias("pillars")))
    return front, F.to_json(F.struct(enhanced.alias("llm_enhanced"), F.lit(run_ts).alias("timestamp")))


def json_lines(scores: DataFrame, findings: DataFrame, run_ts: str) -> DataFrame:
    """JSON reports in pieces: (repo, n, text); the texts of a repo in the order of n are its report.

    Keys are total, pillars, findings, llm_enhanced, timestamp; ``findings`` is null when
    there are none, ``severity`` is left out when it is null. Findings come in the order of
    discovery, one piece each, so that no row and no task holds a whole very large repo.
    """
    found = _discovered(findings)
    counted = found.groupBy("repo").agg(F.max("place").alias("_n"))
    front, back = _head(scores, run_ts)
    some = F.col("_n") > 0
    opening = F.concat(F.regexp_replace(front, r"\}\z", ""), F.lit(',"findings":'), F.when(some, "[").otherwise("null"))
    closing = F.concat(F.when(some, "],").otherwise(","), F.substring(back, 2, 2**31 - 1))
    frame = scores.join(counted, "repo", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    ends = frame.select(
        "repo",
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("long").alias("n"), opening.alias("text")),
                F.struct((F.col("_n") + 1).alias("n"), closing.alias("text")),
            )
        ),
    )
    one = F.to_json(F.struct(*[F.col(c) for c in _FIELDS]))
    listed = found.select(
        "repo", F.col("place").alias("n"), F.concat(F.when(F.col("place") > 1, ",").otherwise(""), one).alias("text")
    )
    return ends.unionByName(listed)


def write_reports(scores: DataFrame, findings: DataFrame, run_ts: str, path: str) -> None:
    """An archive of reports below ``path``: ``scores`` has one JSON object per repo, ``findings`` one per
    finding, with its place."""
    front, back = _head(scores, run_ts)
    repo = F.regexp_replace(F.to_json(F.struct(F.col("repo").cast("string").alias("repo"))), r"\}\z", ",")
    front, back = F.regexp_replace(F.substring(front, 2, 2**31 - 1), r"\}\z", ","), F.substring(back, 2, 2**31 - 1)
    scores.select(F.concat(repo, front, back).alias("value")).write.text(f"{path}/scores")
    rows = _discovered(findings).select(F.col("repo").cast("string").alias("repo"), "place", *_FIELDS)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/findings")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scores, findings) of an archive: one score per repo and report, however many its findings."""
    raw = spark.read.schema(schemas.SCORE).json(f"{path}/scores")
    scores = raw.select(
        "repo", "total", *[F.col("pillars")[p].alias(p) for p in PILLARS], "llm_enhanced", "timestamp"
    )
    return scores, spark.read.schema(f"repo string, place long, {schemas.FINDING_FIELDS}").json(f"{path}/findings")


# -------------------------------------------------------------------------- Markdown
def markdown_lines(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """Markdown reports as rows: (repo, section, rank, location, line_start, n, text).

    The columns before ``text`` are the order of the lines. One row per line keeps a repo
    with very many findings spread over tasks; :func:`write_markdown` puts lines in order.
    Findings are sorted by priority, ties by location and line.
    """
    findings = _complete(findings)
    one = lambda c: number_text(F.col(c), 1)
    head = [F.lit(t) if "{" not in t else F.concat(F.lit("**Quality Score: "), one("total"), F.lit(" / 100**")) for t in K.MARKDOWN_HEAD]
    head += [
        F.concat(F.lit(f"| {K.PILLAR_TITLES[p]} | "), one(p), F.lit(f" / {K.PILLAR_MAX[p]:.0f} |"))
        for p in PILLARS
    ]
    present = findings.groupBy("repo").agg(F.lit(True).alias("_any"))
    marked = scores.join(present, "repo", "left")

    def block(section: int, lines: list[Column]) -> Column:
        return F.transform(
            F.array(*lines),
            lambda t, i: F.struct(F.lit(section).alias("section"), i.alias("n"), t.alias("text")),
        )

    fixed = F.when(
        F.col("_any"),
        F.concat(
            block(0, head),
            block(1, [F.lit(t) for t in K.MARKDOWN_FINDINGS]),
            block(3, [F.lit(t) for t in K.MARKDOWN_FIXES]),
            block(5, [F.lit("")]),
        ),
    ).otherwise(F.concat(block(0, head), block(1, [F.lit(""), F.lit("No findings.")])))
    frame = marked.select("repo", F.inline(fixed)).select(
        "repo",
        "section",
        F.lit(0).alias("rank"),
        F.lit("").alias("location"),
        F.lit(0).alias("line_start"),
        "n",
        "text",
    )
    place = F.coalesce("location", F.lit(""))
    row = F.concat(
        F.lit("| "), "priority", F.lit(" | `"), place, F.lit("` | "),
        F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"),
        F.lit(" | "), "description", F.lit(" |"),
    )
    bullet = F.concat(
        F.lit("- **"), "priority", F.lit("** ("), place, F.lit("): "), "remediation"
    )
    rows = F.array(
        F.struct(F.lit(2).alias("section"), row.alias("text")),
        F.struct(
            F.lit(4).alias("section"),
            F.when(F.coalesce("remediation", F.lit("")) != "", bullet).alias("text"),
        ),
    )
    listed = (
        findings.select(
            "repo", rank(F.col("priority")).alias("rank"), place.alias("location"), "line_start", F.inline(rows)
        )
        .where("text is not null")
        .select("repo", "section", "rank", "location", "line_start", F.lit(0).alias("n"), "text")
    )
    return frame.unionByName(listed)


def write_markdown(lines: DataFrame, path: str) -> None:
    """Text files below ``repo=<repo>``; the lines of a repo are in order over its files."""
    order = ("repo", "section", "rank", "location", "line_start", "n", "text")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("repo", "text").write.partitionBy(
        "repo"
    ).text(path)
