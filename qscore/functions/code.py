"""Function segments of a file and what is measured on them.

Everything works on the line array of one file, so no line ever leaves its row: a
snapshot is scored in one pass over its files without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from qscore import constants as K
from qscore.functions.text import bind, collapse_space


def is_header(line: Column) -> Column:
    return line.rlike(K.FUNCTION_HEADER)


def segments(lines: Column) -> Column:
    """Array of (line_start, line_end, header, body), one per function.

    A function runs from its header to the line before the next header or to the last
    line. Lines before the first header belong to none, the header is not in the body.
    """
    marked = F.transform(lines, lambda line, i: F.when(is_header(line), i))
    return bind(
        F.filter(marked, lambda i: i.isNotNull()),
        lambda starts: F.transform(
            starts, lambda start, k: _segment(lines, start, F.get(starts, k + 1))
        ),
    )


def _segment(lines: Column, start: Column, following: Column) -> Column:
    end = F.coalesce(following, F.size(lines))
    return F.struct(
        (start + 1).alias("line_start"),
        end.alias("line_end"),
        F.get(lines, start).alias("header"),
        F.array_join(F.slice(lines, start + 2, end - start - 1), "\n").alias("body"),
    )


def braces(body: Column) -> Column:
    return F.regexp_replace(body, "[^{}]+", "")


def max_depth(body: Column) -> Column:
    """Highest brace depth; a closing brace at depth zero is ignored."""

    def step(state: Column, brace: Column) -> Column:
        depth = (
            F.when(brace == "{", state["depth"] + 1)
            .when(brace == "}", F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        return F.struct(
            depth.alias("depth"), F.greatest(depth, state["top"]).alias("top")
        )

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top"))
    return F.aggregate(F.split(braces(body), ""), zero, step, lambda s: s["top"])


def may_exceed_depth(body: Column, depth: int = K.MAX_NESTING) -> Column:
    """Cheap test that no deeper body fails: it must open more braces than that."""
    return F.length(body) - F.length(F.replace(body, F.lit("{"), F.lit(""))) > depth


def complexity(body: Column) -> Column:
    """1 + branching tokens."""
    return 1 + F.regexp_count(body, F.lit(K.BRANCH_TOKEN))


def normal_body(body: Column) -> Column:
    """Body with white space collapsed: equal for identical code."""
    return collapse_space(body)


_KEYWORDS = (
    "if", "else", "for", "while", "switch", "case", "default", "return", "break",
    "continue", "try", "catch", "finally", "func", "def", "class", "in", "range",
)


def structure(body: Column) -> Column:
    """Body with strings, numbers and names replaced: equal for code of the same structure.

    Strings become ``""``, numbers ``0`` and names that are no keyword ``@``.
    """
    body = F.regexp_replace(body, r'"[^"\n]*"' + r"|'[^'\n]*'", '""')
    body = F.regexp_replace(body, r"\b[0-9][0-9A-Za-z_.]*", "0")
    keyword = "|".join(_KEYWORDS)
    name = rf"\b(?!(?:{keyword})\b)[A-Za-z_][A-Za-z0-9_]*"
    return collapse_space(F.regexp_replace(body, name, "@"))
