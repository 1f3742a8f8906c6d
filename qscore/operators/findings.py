"""Detectors and the findings of a snapshot.

A detector maps (path, content, lines) columns to an array of finding structs. All
detectors of a run are evaluated in one pass over the files: no shuffle, no second scan,
and no row per line. Own detectors are plain functions of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from qscore import constants as K
from qscore.functions import code, text

Detector = Callable[[Column, Column, Column], Column]

_FIELDS = (
    ("priority", "string"),
    ("pillar", "string"),
    ("location", "string"),
    ("line_start", "int"),
    ("line_end", "int"),
    ("description", "string"),
    ("remediation", "string"),
    ("severity", "string"),
)
FINDING_COLUMNS = tuple(name for name, _ in _FIELDS)
_TYPE = "array<struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">>"


def no_findings() -> Column:
    return F.array().cast(_TYPE)


def finding(**values: Column | str | int | None) -> Column:
    """Finding struct; texts not given are empty and numbers 0. Only a severity may be absent."""
    cells = []
    for name, kind in _FIELDS:
        value = values.get(name, None if name == "severity" else 0 if kind == "int" else "")
        cell = value if isinstance(value, Column) else F.lit(value)
        cells.append(cell.cast(kind).alias(name))
    return F.struct(*cells)


def secrets(path: Column, content: Column, lines: Column) -> Column:
    """One finding per line with a hard-coded secret."""
    hit_lines = F.filter(
        F.transform(lines, lambda line, i: F.when(text.has_secret(line), i + 1)),
        lambda n: n.isNotNull(),
    )
    found = F.transform(
        hit_lines,
        lambda n: finding(
            priority="HIGH",
            pillar=K.SECURITY,
            location=path,
            line_start=n,
            line_end=n,
            description=K.SECRET_TEXT,
            remediation=K.SECRET_FIX,
            severity="HIGH",
        ),
    )
    return F.when(text.has_secret(content), found).otherwise(no_findings())


def deep_nesting(path: Column, content: Column, lines: Column) -> Column:
    """One finding per function nested deeper than allowed."""
    candidates = F.filter(
        code.segments(lines), lambda s: code.may_exceed_depth(s["body"])
    )
    measured = F.transform(
        candidates,
        lambda s: F.struct(
            s["line_start"].alias("line_start"),
            s["line_end"].alias("line_end"),
            code.max_depth(s["body"]).alias("depth"),
        ),
    )
    found = F.transform(
        F.filter(measured, lambda s: s["depth"] > K.MAX_NESTING),
        lambda s: finding(
            priority="MEDIUM",
            pillar=K.ARCHITECTURE,
            location=path,
            line_start=s["line_start"],
            line_end=s["line_end"],
            description=F.format_string(K.NESTING_TEXT, s["depth"], F.lit(K.MAX_NESTING)),
            remediation=K.NESTING_FIX,
        ),
    )
    return F.when(code.may_exceed_depth(content), found).otherwise(no_findings())


def poor_names(path: Column, content: Column, lines: Column) -> Column:
    """One finding per line and name that says nothing. Opt-in: it lowers the static pillar."""

    def on_line(line: Column, i: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(line, F.lit(K.POOR_NAME), F.lit(1)))
        return F.transform(
            names,
            lambda name: finding(
                priority="LOW",
                pillar=K.STATIC,
                location=path,
                line_start=i + 1,
                line_end=i + 1,
                description=F.concat(F.lit("Name does not tell its purpose: "), name),
                remediation=F.concat(
                    F.lit("Rename "), name, F.lit(" after what it holds on this line")
                ),
            ),
        )

    return F.when(
        content.rlike(K.POOR_NAME), F.flatten(F.transform(lines, on_line))
    ).otherwise(no_findings())


DEFAULT_DETECTORS: tuple[Detector, ...] = (secrets, deep_nesting)


def findings(
    files: DataFrame,
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
    keys: Sequence[str] = ("repo",),
) -> DataFrame:
    """One row per finding: the key columns and the eight finding columns."""
    path, content = F.col("path"), F.col("content")
    found = text.bind(
        text.lines_of(content),
        lambda lines: F.concat(*[d(path, content, lines) for d in detectors]),
    )
    return files.select(*keys, F.inline(found))


def function_segments(files: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One row per function: keys, line_start, line_end, header, body. Narrow."""
    return files.select(
        *keys, F.inline(text.bind(text.lines_of(F.col("content")), code.segments))
    )


def function_measures(files: DataFrame) -> DataFrame:
    """Depth and complexity of every function."""
    return function_segments(files).select(
        "repo",
        "path",
        "line_start",
        "line_end",
        code.max_depth(F.col("body")).alias("depth"),
        code.complexity(F.col("body")).cast("int").alias("complexity"),
    )


def numbered_lines(texts: DataFrame, keys: Sequence[str], column: str = "content") -> DataFrame:
    """One row per line: keys, 1-based line_no, line."""
    return texts.select(
        *keys, F.posexplode(text.lines_of(F.col(column))).alias("_pos", "line")
    ).select(*keys, (F.col("_pos") + 1).alias("line_no"), "line")


def diff_secrets(diffs: DataFrame, keys: Sequence[str], column: str = "diff") -> DataFrame:
    """Secrets on added lines of a unified diff (the ``+++`` header counts as one)."""
    added = (
        diffs.where(text.has_secret(F.col(column)))
        .select(*keys, F.explode(text.lines_of(F.col(column))).alias("_line"))
        .where(F.col("_line").startswith("+") & text.has_secret(F.substring("_line", 2, 2**31 - 1)))
    )
    found = finding(
        priority="HIGH",
        pillar=K.SECURITY,
        description=K.DIFF_SECRET_TEXT,
        remediation=K.DIFF_SECRET_FIX,
        severity="HIGH",
    )
    return added.select(*keys, F.inline(F.array(found)))


def redaction_counts(files: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Redactions per file and pattern, for a warning beside the scrubbed text."""
    names = ("api_keys", "passwords", "sk_tokens", "bearer_tokens", "private_keys")
    counts = text.redactions(F.col("content"))
    return files.select(
        *keys, *[c.cast("int").alias(n) for c, n in zip(counts, names)]
    ).where(" + ".join(names) + " > 0")


def truncated_locations(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    return rows.select(*keys, text.truncate(F.col("location"), size).alias("location"))
