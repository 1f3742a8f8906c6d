"""Repeated runs of symbols (bytes or words) across all documents, found through winnowed anchors.

A *window* is ``length`` consecutive symbols of a document. Among its grams (``gram`` symbols each) the one
with the smallest hash, the leftmost of equals, is its *anchor*. Equal windows have the same anchor at the
same place, so windows need only be compared where their anchors have the same gram, and there are few
anchors: two for every ``length - gram + 2`` symbols. An anchor stands for the windows around it, one after
the other, that chose it; ``lo`` and ``hi`` say where they begin, counted from the anchor.

1. Grams that occur once are dropped: nothing around them repeats.
2. Where all anchors of a gram have equal surroundings (as far as their windows go), all windows repeat.
3. The others are extended: of each distinct surrounding one document gives the hashes of its windows, and
   equal hashes are equal windows.

Copies and passages that very many documents share are counted before rows are shuffled (1), settled
without comparing them with each other (2), or stand for each other as one surrounding (3): work and rows
grow with the text, not with the pairs. Hashes have 64 bits; grams and their surroundings, or grams and
their windows, must both agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from qscore.shared import fresh_path

_PIECE = 1 << 19  # symbols that are looked at together; a longer document goes in overlapping pieces
_INDEX = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []
# Shuffle files of a query go when the query is over, as intermediate results are written as tables; and
# Python sees some megabytes of text at a time.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


@contextmanager
def lean(spark: SparkSession):
    """Settings for steps that move much text; they are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Intermediate results in the shared folder; what is no longer needed can be dropped at once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self.paths[label] = fresh_path(self.spark, label)
        df.write.parquet(self.paths[label])
        return self.spark.read.schema(df.schema).parquet(self.paths[label])

    def drop(self, label: str) -> None:
        """Nothing takes the place of the table, so its files go."""
        self.spark.range(0).write.mode("overwrite").parquet(self.paths.pop(label))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _scales() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(2 * _PIECE + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


class _Hashes:
    """Hashes of any run of a piece, from sums of all its beginnings."""

    def __init__(self, symbols: np.ndarray) -> None:
        power, self.inverse = _scales()
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _piece(symbols: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of documents that lie one after the other: number of the document, place in it, lo, hi, g, c."""
    n = len(symbols)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in _COLUMNS}
    hashes = _Hashes(symbols)
    at = np.arange(n - gram + 1)
    grams = _mix((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.inverse[: n - gram + 1])
    chosen = (_smallest((grams & ~_INDEX) | at.astype(np.uint64), length - gram + 1) & _INDEX).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.flatnonzero(np.repeat(ends, lengths)[: n - length + 1] >= np.arange(length, n + 1))
    anchor = chosen[inside]
    if not len(anchor):
        return {k: np.zeros(0, np.int64) for k in _COLUMNS}
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    anchor, low, high = anchor[first], inside[first], inside[last]
    around = hashes.of(low, high + length)
    number = np.searchsorted(ends, anchor, side="right")
    lo, hi = low - anchor, high - anchor
    c = _mix(around + lo.astype(np.uint64) * _M1 + hi.astype(np.uint64) * _M2)
    return {
        "number": number, "pos": anchor - (ends - lengths)[number], "lo": lo, "hi": hi,
        "g": grams[anchor].view(np.int64), "c": c.view(np.int64),
    }


Reader = Callable[[bytes | None], np.ndarray]
_COLUMNS = ("number", "pos", "lo", "hi", "g", "c")


def _chunks(texts: Iterable[bytes | None], read: Reader, length: int) -> Iterator[tuple]:
    """Numbers and lengths of documents, their symbols one after the other, and where the first one begins:
    whole documents together, or a part of a long one. Each window is in exactly one chunk."""
    held: list[tuple[int, np.ndarray]] = []

    def together() -> tuple:
        parts = [x for _, x in held]
        return np.array([i for i, _ in held]), np.array([len(x) for x in parts]), np.concatenate(parts), 0

    size = 0
    for i, text in enumerate(texts):
        symbols = read(text)
        if len(symbols) < length:
            continue
        if len(symbols) > _PIECE:
            for start in range(0, len(symbols) - length + 1, _PIECE - length + 1):
                part = symbols[start : start + _PIECE]
                yield np.array([i]), np.array([len(part)]), part, start
            continue
        if size + len(symbols) > _PIECE:
            yield together()
            held, size = [], 0
        held.append((i, symbols))
        size += len(symbols)
    if held:
        yield together()


def _anchors(texts: Iterable[bytes | None], read: Reader, length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Anchors by chunk; all anchors of one document come together. ``number`` is the place in ``texts``."""
    parts: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([x[k] for x in parts]) for k in _COLUMNS}

    for numbers, lengths, symbols, start in _chunks(texts, read, length):
        found = _piece(symbols, lengths, length, gram)
        found |= {"number": numbers[found["number"]], "pos": found["pos"] + start}
        if parts and (not start or parts[0]["number"][0] != numbers[0]):
            yield joined()
            parts = []
        if len(found["pos"]):
            parts.append(found)
    if parts:
        yield joined()


def _entries(read: Reader, length: int, gram: int):
    """For each document and gram: how often, the smallest and largest surroundings, the first place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = batch["doc"].to_numpy()
            for found in _anchors(batch["text"], read, length, gram):
                order = np.lexsort((found["pos"], found["g"], found["number"]))
                number, g, c, pos = (found[k][order] for k in ("number", "g", "c", "pos"))
                at = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (g[1:] != g[:-1])])
                yield pd.DataFrame(
                    {
                        "g": g[at], "c1": np.minimum.reduceat(c, at), "c2": np.maximum.reduceat(c, at),
                        "n": np.diff(np.r_[at, len(g)]), "doc": docs[number[at]], "pos": pos[at],
                    }
                )

    return run


def _members(read: Reader, length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = batch["doc"].to_numpy()
            for x in _anchors(batch["text"], read, length, gram):
                yield pd.DataFrame(
                    {"g": x["g"], "c": x["c"], "doc": docs[x["number"]], "pos": x["pos"], "lo": x["lo"], "hi": x["hi"]}
                )

    return run


def _windows(read: Reader, length: int, gram: int):
    """Hashes of all windows of the anchors that a document is asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in batch["pos"]])))
            g, pos, lo, hi, o, n = (np.concatenate(batch[k].to_list()) for k in _ASKED)
            for numbers, lengths, symbols, start in _chunks(batch["text"], read, length):
                asked = bounds[numbers + 1] - bounds[numbers]
                within = np.repeat(np.arange(len(numbers)), asked)
                at = np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked) + bounds[numbers][within]
                shift = (np.cumsum(lengths) - lengths)[within] - start
                end = (shift + start + lengths[within]) - length
                count = (hi[at] - lo[at] + 1).astype(np.int64)
                of = np.repeat(np.arange(len(at)), count)
                delta = lo[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                anchor = pos[at][of] + shift[of]
                first = anchor + delta
                # What lies in another chunk, or in another document of the same doc, is left out.
                here = np.flatnonzero((first >= (shift + start)[of]) & (first <= end[of]))
                of, delta, anchor, first = of[here], delta[here], anchor[here], first[here]
                hashes = _Hashes(symbols)
                here = np.flatnonzero(hashes.of(anchor, anchor + gram).view(np.int64) == g[at][of])
                of, delta, first = of[here], delta[here], first[here]
                yield pd.DataFrame(
                    {
                        "g": g[at][of], "h": hashes.of(first, first + length).view(np.int64),
                        "o": o[at][of], "delta": delta.astype(np.int8), "n": n[at][of],
                    }
                )

    return run


_ASKED = ("g", "pos", "lo", "hi", "o", "n")
_ENTRY = "g long, c1 long, c2 long, n long, doc long, pos long"


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("g").agg(
        F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.sum("n").alias("n"),
        F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos"),
    )


class Levels:
    """The sparse suffixes of all batches so far, one entry for each distinct gram that a suffix begins with,
    in levels that double in size.

    A batch comes in as a level of its own; while the last two levels hold as many batches, they are
    merged by gram into one. ``repeated`` scans all levels together.
    """

    def __init__(self, tables: Tables, read: Reader, length: int, gram: int) -> None:
        self.tables, self.read, self.length, self.gram = tables, read, length, gram
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.added = 0

    def _of(self, docs: DataFrame) -> DataFrame:
        return docs.mapInPandas(_entries(self.read, self.length, self.gram), _ENTRY)

    def add(self, docs: DataFrame) -> None:
        weight, entries, merged = 1, self._of(docs), []
        while self.levels and self.levels[-1][0] == weight:
            _, name, level = self.levels.pop()
            entries = entries.unionByName(level)
            merged.append(name)
            weight *= 2
        self.added += 1
        name = f"suffixes-{self.added}"
        self.levels.append((weight, name, self.tables.write(_merged(entries), name)))
        for old in merged:
            self.tables.drop(old)

    def repeated(self, last: DataFrame | None = None) -> DataFrame:
        """Grams that occur more than once: alone (all surroundings equal), first_doc, first_pos. ``last`` is a
        batch that is scanned with the levels but not kept."""
        parts = [level for _, _, level in self.levels] + ([self._of(last)] if last is not None else [])
        entries = parts[0]
        for part in parts[1:]:
            entries = entries.unionByName(part)
        return _merged(entries).where("n > 1").select(
            "g", (F.col("c1") == F.col("c2")).alias("alone"),
            F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"),
        )


def marks(docs: DataFrame, tables: Tables, read: Reader, length: int, gram: int, repeated: DataFrame, earlier: bool) -> DataFrame:
    """(doc, marks): for each document with repeated windows, an array of (pos, mask); bit i of mask says
    that the window that begins i symbols before pos repeats.

    ``docs`` has doc and text. With ``earlier``, a window repeats if an equal one starts earlier (in a
    smaller doc, or earlier in the same); without, if an equal one starts anywhere else.
    """
    assert length - gram < 63
    members = docs.mapInPandas(_members(read, length, gram), "g long, c long, doc long, pos long, lo int, hi int")
    hits = tables.write(members.join(repeated.hint("shuffle_hash"), "g"), "repeat-hits")
    first = (F.col("doc") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    # Bits -hi to -lo.
    whole = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - hi + lo), -hi)")
    sure = hits.where(F.col("alone") & ~first if earlier else F.col("alone")).select("doc", "pos", whole.alias("mask"))

    unlike = hits.where("not alone")
    classes = unlike.groupBy("g", "c").agg(
        F.min(F.struct("doc", "pos")).alias("_first"), F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")
    )
    # o puts surroundings in order of where they first occur. Equal windows lie equally far from their
    # anchors, so the order of the windows is that of the surroundings.
    classes = (
        classes.select("g", "c", "_first.doc", "_first.pos", "lo", "hi", "n")
        .repartitionByRange("doc", "pos").sortWithinPartitions("doc", "pos")
        .withColumn("o", F.monotonically_increasing_id())
    )
    classes = tables.write(classes, "repeat-classes")
    wanted = classes.groupBy("doc").agg(F.collect_list(F.struct(*_ASKED)).alias("wanted"))
    asked = docs.join(wanted, "doc").select("doc", "text", *[F.col(f"wanted.{k}").alias(k) for k in _ASKED])
    windows = asked.mapInPandas(_windows(read, length, gram), "g long, h long, o long, delta byte, n long")
    windows = tables.write(windows, "repeat-windows")
    same = windows.groupBy("g", "h").agg(F.min("o").alias("_o"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    same = tables.write(same.where("_k > 1" if earlier else "_n > 1").select("g", "h", "_o"), "repeat-same")
    judged = windows.join(same.hint("shuffle_hash"), ["g", "h"])
    if earlier:
        judged = judged.where("o != _o")
    masks = judged.groupBy("o").agg(F.bit_or(F.expr("shiftleft(1L, -delta)")).alias("some"))
    # Of surroundings that occur more than once, all windows repeat, but for those that start earliest.
    some = F.coalesce("some", F.lit(0).cast("long"))
    masks = classes.join(masks, "o", "left").select(
        "g", "c", F.col("doc").alias("_d"), F.col("pos").alias("_p"), some.alias("some"),
        F.when(F.col("n") > 1, whole).otherwise(some).alias("every"),
    ).where("every != 0")
    masks = tables.write(masks, "repeat-masks")
    for label in ("repeat-windows", "repeat-same", "repeat-classes"):
        tables.drop(label)
    is_first = (F.col("doc") == F.col("_d")) & (F.col("pos") == F.col("_p")) if earlier else F.lit(False)
    extended = unlike.join(masks.hint("shuffle_hash"), ["g", "c"]).select(
        "doc", "pos", F.when(is_first, F.col("some")).otherwise(F.col("every")).alias("mask")
    )
    found = sure.unionByName(extended.where("mask != 0"))
    if not earlier:
        # Rows that repeat a text under the same key count once, however many they are.
        found = found.groupBy("doc", "pos").agg(F.bit_or("mask").alias("mask"))
    return found.groupBy("doc").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))


def covered(n: int, pos: np.ndarray | None, mask: np.ndarray | None, length: int) -> np.ndarray:
    """Which of n symbols lie in a marked window."""
    steps = np.zeros(n + 1, np.int64)
    if pos is not None and len(pos):
        row, bits = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
        start = pos[row] - bits
        start = start[(start >= 0) & (start + length <= n)]
        np.add.at(steps, start, 1)
        np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:n]) > 0
