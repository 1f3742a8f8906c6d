"""Line and text expressions: secrets, redaction, white space, number text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from qscore import constants as K

ANY_SECRET = K.FOLD + "(?:" + "|".join(K.SECRET_PATTERNS) + ")"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def once(**values: Column) -> Column:
    """Columns that are computed once per row, even when a later filter uses them.

    A filter on a plain projection is evaluated below it and computes the value again;
    one on a generator's output is not.
    """
    return F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))


def lines_of(content: Column) -> Column:
    """Lines split on LF only: a trailing LF gives a last empty line, CR is kept."""
    return F.split(content, "\n", -1)


def has_secret(text: Column) -> Column:
    """On a line: the detection rule. On a whole text: a filter that loses no such line."""
    return text.rlike(ANY_SECRET)


def secret_pattern(line: Column) -> Column:
    """1-based number of the first detection pattern that matches."""
    return F.coalesce(
        *[F.when(line.rlike(K.FOLD + p), i) for i, p in enumerate(K.SECRET_PATTERNS, 1)]
    )


def scrub(text: Column) -> Column:
    """Every scrub pattern in turn over the whole text."""
    for p in K.SCRUB_PATTERNS:
        text = F.regexp_replace(text, K.FOLD + p, K.REDACTED)
    return text


def redactions(text: Column) -> list[Column]:
    """Matches of each scrub pattern in the text as the patterns before it left it."""
    counts = []
    for p in K.SCRUB_PATTERNS:
        counts.append(F.regexp_count(text, F.lit(K.FOLD + p)))
        text = F.regexp_replace(text, K.FOLD + p, K.REDACTED)
    return counts


def is_blank(text: Column) -> Column:
    """White space only and not empty."""
    return text.rlike(r"\A[" + K.WHITE_SPACE + r"]+\z")


def trim_space(text: Column) -> Column:
    space = "[" + K.WHITE_SPACE + "]+"
    return F.regexp_replace(text, rf"\A{space}|{space}\z", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[" + K.WHITE_SPACE + "]+", " "))


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` bytes, the last three of them dots; cut on characters, never inside one.

    The longest beginning of at most ``size`` - 3 bytes: bytes that end inside a character have one or
    two or three more bytes of it to drop, which start with the bits 10.
    """
    raw, room = text.cast("binary"), size - 3
    inside = lambda n: F.conv(F.hex(F.substring(raw, n, 1)), 16, 10).cast("int").between(128, 191)
    kept = F.lit(room - 3)
    for less in (2, 1, 0):
        kept = F.when(~inside(room - less + 1), room - less).otherwise(kept)
    cut = F.substring(raw, F.lit(1), kept).cast("string")
    return F.when(F.octet_length(text) > size, F.concat(cut, F.lit("..."))).otherwise(text)


def number_text(value: Column, digits: int) -> Column:
    """Fixed decimals with exact ties to even."""
    exact = F.bround(value.cast("decimal(38,18)"), digits)
    return exact.cast(f"decimal(38,{digits})").cast("string")
