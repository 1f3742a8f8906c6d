"""Line diffs of changed files, made and applied.

A file is one cell, so both versions of a file meet in one row, and its lines are aligned there; files are
aligned in parallel. Lines that occur once on both sides are anchors; of these the longest run that keeps its
order stays, and the gaps between are aligned in the same way. Where a gap has no such line, the n-th
occurrence of a line goes with the n-th of the other side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from qscore.functions import text
from qscore.operators.changes import _FILE, opened

CONTEXT = 3


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first place, whose second places rise."""
    ends: list[int] = []
    last: list[int] = []
    before = []
    for at, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [at]
    run, at = [], last[-1] if last else -1
    while at >= 0:
        run.append(pairs[at])
        at = before[at]
    return run[::-1]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal lines that may be aligned, by lines that occur once, else by the number of the occurrence."""
    once_a, once_b = ({x for x, n in Counter(s).items() if n == 1} for s in (a, b))
    once = once_a & once_b
    if once:
        at = {x: j for j, x in enumerate(b) if x in once}
        return _in_order([(i, at[x]) for i, x in enumerate(a) if x in once])

    def numbered(lines: list[str]) -> Iterator[tuple[str, int]]:
        seen: Counter[str] = Counter()
        for x in lines:
            seen[x] += 1
            yield x, seen[x]

    at = {x: j for j, x in enumerate(numbered(b))}
    return _in_order([(i, at[x]) for i, x in enumerate(numbered(a)) if x in at])


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of equal lines, rising on both sides."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, start, end = todo.pop()
        while lo < hi and start < end and a[lo] == b[start]:
            found.append((lo, start))
            lo, start = lo + 1, start + 1
        while lo < hi and start < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            found.append((hi, end))
        if lo == hi or start == end:
            continue
        at, to = lo, start
        anchors = [(lo + i, start + j) for i, j in _anchors(a[lo:hi], b[start:end])]
        found += anchors
        for i, j in [*anchors, (hi, end)] if anchors else ():
            if at < i and to < j:
                todo.append((at, i, to, j))
            at, to = i + 1, j + 1
    return sorted(found)


def hunks(a: list[str], b: list[str], context: int = CONTEXT) -> list[tuple[int, int, int, int, str]]:
    """(base_start, base_lines, target_start, target_lines, body) of each hunk; lines count from 1, and a side
    without lines starts at the line before the hunk."""
    steps: list[tuple[str, int, int]] = []  # kind, and how many lines of each side stand before
    at, to = 0, 0
    for i, j in [*aligned(a, b), (len(a), len(b))]:
        steps += [("-", k, to) for k in range(at, i)]
        steps += [("+", i, k) for k in range(to, j)]
        steps += [(" ", i, j)] if i < len(a) else []
        at, to = i + 1, j + 1
    changed = [n for n, s in enumerate(steps) if s[0] != " "]
    out, n = [], 0
    while n < len(changed):
        m = n
        while m + 1 < len(changed) and changed[m + 1] - changed[m] <= 2 * context + 1:
            m += 1
        part = steps[max(0, changed[n] - context) : changed[m] + context + 1]
        olds, news = sum(s[0] != "+" for s in part), sum(s[0] != "-" for s in part)
        body = "\n".join(kind + (b[j] if kind == "+" else a[i]) for kind, i, j in part)
        out.append((part[0][1] + (olds > 0), olds, part[0][2] + (news > 0), news, body))
        n = m + 1
    return out


def patched(a: list[str], parts: list[tuple[int, int, str]]) -> list[str] | None:
    """``a`` after hunks (base_start, base_lines, body) in order; None where their context is not that of ``a``."""
    out, at = [], 0
    for start, olds, body in parts:
        first = start - (olds > 0)
        lines = body.split("\n")
        if first < at or a[first : first + olds] != [x[1:] for x in lines if x[:1] != "+"]:
            return None
        out += a[at:first] + [x[1:] for x in lines if x[:1] != "-"]
        at = first + olds
    return out + a[at:]


_HUNK = "base_start int, base_lines int, target_start int, target_lines int, body string"


def unified_diffs(base: DataFrame, target: DataFrame, changed: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(repo, path, change_type, hunk from 1, base_start, base_lines, target_start, target_lines, body): the hunks that
    turn the base version of each file in ``changed`` (see :func:`changes.snapshot_changes`) into the target's.

    Lines are split on LF only; a last LF gives an empty last line, so no line needs a mark, and CR is kept. A
    file that is added or deleted is one hunk, also if it is empty (one empty line). Null content is no file.
    Only files in ``changed`` are opened.
    """

    @F.pandas_udf(f"array<struct<{_HUNK.replace(' int', ':int').replace(' string', ':string')}>>")
    def made(olds: pd.Series, news: pd.Series) -> pd.Series:
        none: list[str] = []
        return pd.Series(
            [
                [dict(zip(_NAMES, h)) for h in hunks(none if a is None else list(a), none if b is None else list(b), context)]
                for a, b in zip(olds, news)
            ],
            dtype=object,
        )

    def lines(files: DataFrame, name: str) -> DataFrame:
        return opened(files, changed).select(*_FILE, text.lines_of(F.col("content")).alias(name))

    both = lines(base, "_b").join(lines(target, "_t"), list(_FILE), "full_outer")
    rows = both.select(*_FILE, F.posexplode(made("_b", "_t")).alias("_n", "_h"))
    rows = rows.select(*_FILE, (F.col("_n") + 1).alias("hunk"), "_h.*")
    return rows.join(changed.select(*_FILE, "change_type"), list(_FILE)).select(*_FILE, "change_type", "hunk", *_NAMES)


_NAMES = ("base_start", "base_lines", "target_start", "target_lines", "body")


def diff_texts(diffs: DataFrame) -> DataFrame:
    """(repo, path, diff): each file's hunks as one unified diff, with file headers."""
    header = F.format_string("@@ -%d,%d +%d,%d @@", "base_start", "base_lines", "target_start", "target_lines")
    parts = F.sort_array(F.collect_list(F.struct("hunk", F.concat_ws("\n", header, "body").alias("part"))))
    kind = F.max("change_type").alias("_kind")
    files = diffs.groupBy(*_FILE).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("_parts"), kind)
    old = F.when(F.col("_kind") == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), "path"))
    new = F.when(F.col("_kind") == "deleted", "/dev/null").otherwise(F.concat(F.lit("b/"), "path"))
    head = F.concat(F.lit("--- "), old, F.lit("\n+++ "), new)
    return files.select(*_FILE, F.concat_ws("\n", head, "_parts").alias("diff"))


def apply_diffs(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """(repo, path, content): the files of ``diffs`` as they are after it. A deleted file has no row; a file that is
    not as the hunks say has null content."""
    ordered = F.sort_array(F.collect_list(F.struct("hunk", "base_start", "base_lines", "body")))
    files = diffs.groupBy(*_FILE).agg(ordered.alias("_hunks"), F.max("change_type").alias("change_type"))
    old = opened(base, files).select(*_FILE, text.lines_of(F.col("content")).alias("_lines"))

    @F.pandas_udf("string")
    def made(olds: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for a, p in zip(olds, parts):
            new = patched([] if a is None else list(a), [(h["base_start"], h["base_lines"], h["body"]) for h in p])
            out.append(None if new is None else "\n".join(new))
        return pd.Series(out, dtype=object)

    rows = files.where("change_type <> 'deleted'").join(old, list(_FILE), "left")
    return rows.select(*_FILE, made("_lines", "_hunks").alias("content"))


def line_changes(diffs: DataFrame) -> DataFrame:
    """(repo, path, change, line_no, line): the lines that each diff adds (numbered in the target) and removes
    (numbered in the base). A moved line is both."""
    lines = F.split(F.col("body"), "\n", -1)
    rows = diffs.select(*_FILE, "base_start", "target_start", lines.alias("_l"))

    def side(sign: str, change: str, start: str) -> DataFrame:
        other = "+" if sign == "-" else "-"
        mine = F.filter("_l", lambda x: ~x.startswith(other))
        place = F.col(start) + F.col("_n")
        found = rows.select(*_FILE, start, F.posexplode(mine).alias("_n", "_x")).where(F.col("_x").startswith(sign))
        return found.select(*_FILE, F.lit(change).alias("change"), place.cast("int").alias("line_no"), F.expr("substring(_x, 2)").alias("line"))

    return side("+", "added", "target_start").unionByName(side("-", "removed", "base_start"))
