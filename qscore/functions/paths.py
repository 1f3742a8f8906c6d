"""Path expressions and glob patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from qscore import constants as K


def extension(path: Column) -> Column:
    """Last dot of the last segment onwards, or the empty string."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; both absolute, ``root`` without a trailing slash."""
    return F.substring(path, len(root.rstrip("/")) + 2, 2**31 - 1)


def walk_order(path: Column) -> Column:
    """Sort key of a directory walk: segments compare one by one, not the whole string."""
    return F.split(path, "/")


def _has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Test of the lower-cased extension, without a regular expression.

    What follows the last dot of the whole path is compared: it holds a slash, and so
    matches nothing, where the last segment has no dot.
    """
    last = F.lower(F.substring_index(path, ".", -1))
    return path.contains(".") & last.isin(*[e.lstrip(".") for e in extensions])


def is_source(path: Column) -> Column:
    return _has_extension(path, K.SOURCE_EXTENSIONS)


def is_non_code(path: Column) -> Column:
    """Known names (case-sensitive) or extensions. Not the complement of is_source."""
    return base_name(path).isin(*K.NON_CODE_NAMES) | _has_extension(
        path, K.NON_CODE_EXTENSIONS
    )


# --------------------------------------------------------------------------- globs
_TOKEN = re.compile(
    r"(?P<deep>(?:(?<=^)|(?<=/))\*\*(?:/|$))"
    r"|(?P<tail>/\*\*$)"
    r"|(?P<star>\*+)"
    r"|(?P<one>\?)"
    r"|(?P<set>\[[!^]?(?:\\.|[^\]\\])+\])"
    r"|(?P<alt>[{},])"
    r"|\\(?P<esc>.)"
    r"|(?P<lit>[^\\\[])",
    re.S,
)


_MEMBER = re.compile(r"\\(?P<esc>.)|(?P<plain>.)", re.S)


def _set_body(text: str) -> str | None:
    """Members of a glob's set, escaped one by one; None for a range that is backwards or open."""
    members = [(m["esc"] or m["plain"], m["plain"] == "-") for m in _MEMBER.finditer(text)]
    out, i = [], 0
    while i < len(members):
        low, dash = members[i]
        if dash and 0 < i:
            return None
        if i + 1 < len(members) and members[i + 1][1]:
            if i + 2 == len(members) or members[i + 2][0] < low:
                return None
            out.append(f"{_member(low)}-{_member(members[i + 2][0])}")
            i += 3
        else:
            out.append(_member(low))
            i += 1
    return "".join(out)


def _member(char: str) -> str:
    return char if char.isalnum() or char in "/_ ." or ord(char) > 127 else "\\" + char


def glob_regex(pattern: str) -> str | None:
    """Anchored regular expression of a glob, or None for a malformed one.

    ``**`` as a whole segment takes any number of segments, none included, so that
    ``a/**`` also matches ``a``. ``*`` and ``?`` stay within a segment. ``[..]`` and
    ``{a,b}`` are supported. The result is valid both in Java and in RE2.
    """
    out, pos, braces = ["^"], 0, 0
    if pattern.startswith("**/"):
        # Any directory, so the rest may start anywhere a segment does.
        out, pos = ["(?:^|/)"], 3
    while pos < len(pattern):
        m = _TOKEN.match(pattern, pos)
        if m is None:
            return None
        kind, text = m.lastgroup, m.group()
        pos = m.end()
        if kind == "tail":
            return None if braces else "".join(out) + r"(?:/|\z)"
        elif kind == "deep":
            out.append("(?:(?s:.)*/)?" if text.endswith("/") else "(?s:.)*")
        elif kind == "star":
            out.append("[^/]*")
        elif kind == "one":
            out.append("[^/]")
        elif kind == "set":
            negated = text[1] in "!^"
            body = _set_body(text[2 if negated else 1 : -1])
            if body is None:
                return None
            out.append(f"[{'^/' if negated else ''}{body}]")
        elif kind == "alt" and (braces or text == "{"):
            braces += {"{": 1, "}": -1, ",": 0}[text]
            out.append({"{": "(?:", "}": ")", ",": "|"}[text])
        else:
            out.append(re.escape(m.group("esc") or text))
    return None if braces else "".join(out) + r"\z"


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """True where any glob matches, as one regular expression; malformed globs match nothing."""
    regexes = [r for r in map(glob_regex, patterns) if r]
    return path.rlike("|".join(regexes)) if regexes else F.lit(False)
