"""Packing of tokenized documents into sequences of one length, by best-fit decreasing.

Documents longer than a window are first cut into full windows. What remains of each is placed, longest first,
into the open window that it leaves the least room in: a segment tree indexed by remaining capacity finds it.
Documents are packed with those of their partition, in groups of some thousand, while they are read: each text
is tokenized once, and nothing is written or shuffled on the way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from qscore.llm.tokens import encoder

WINDOW = 2048
END = 1
PADDING = 0.005
_GROUP = 8192  # documents that are packed together
_SENT = 8 << 20  # bytes of pieces that go back to Spark at once
_COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


class Open:
    """Open windows by remaining capacity; every node of the tree counts those below it."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least capacity that ``length`` fits in: (window, capacity)."""
        at, count = length + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return self.windows[capacity].pop(), capacity


Piece = tuple[int, int, int]  # document, start, length


def best_fit(pieces: list[Piece], window: int) -> list[list[Piece]]:
    """Windows of ``pieces``, none longer than ``window``, by best-fit decreasing."""
    room, windows = Open(window), []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        found = room.tightest(piece[2])
        at, capacity = found or (len(windows), window)
        if found is None:
            windows.append([])
        windows[at].append(piece)
        if capacity > piece[2]:
            room.add(capacity - piece[2], at)
    return windows


def filled_up(windows: list[list[Piece]], window: int, padding: float) -> list[list[Piece]]:
    """Where more than ``padding`` of all room is left, the emptiest windows are cut up to fill the others."""
    fill = [sum(p[2] for p in w) for w in windows]
    total = sum(fill)
    enough = max(-(-total // window), int(total * (1 + padding) / window))
    if len(windows) <= enough:
        return windows
    order = sorted(range(len(windows)), key=lambda i: -fill[i])
    kept = [list(windows[i]) for i in order[:enough]]
    loose = [p for i in order[enough:] for p in windows[i]]
    for at in range(enough - 1, -1, -1):  # the largest gaps first
        gap = window - fill[order[at]]
        while gap and loose:
            document, start, length = loose.pop()
            taken = min(gap, length)
            kept[at].append((document, start, taken))
            if taken < length:
                loose.append((document, start + taken, length - taken))
            gap -= taken
    return kept


class _Packer:
    """Rows of pieces; full windows at once, what remains of documents in groups."""

    def __init__(self, window: int, padding: float, sequence: int) -> None:
        self.window, self.padding, self.sequence = window, padding, sequence
        self.rests: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.rows: list[tuple] = []
        self.size = 0

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, self.sequence, offset))
            offset += len(ids) // 4
            self.size += 100 + len(ids)
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        n, step = len(ids) // 4, 4 * self.window
        for at in range(0, len(ids) - step + 1, step):
            self._put([(doc_id, at // 4, ids[at : at + step], n)])
        if len(ids) % step:
            at = len(ids) - len(ids) % step
            self.rests.append((doc_id, at // 4, ids[at:], n))
        if len(self.rests) == _GROUP:
            self.close()

    def close(self) -> None:
        """Places what remains of the documents so far."""
        rests, self.rests = self.rests, []
        pieces = [(i, 0, len(r[2]) // 4) for i, r in enumerate(rests)]
        for pieces in filled_up(best_fit(pieces, self.window), self.window, self.padding):
            self._put(
                [(rests[i][0], rests[i][1] + at, rests[i][2][4 * at : 4 * (at + n)], rests[i][3]) for i, at, n in pieces]
            )

    def taken(self) -> list[tuple]:
        rows, self.rows, self.size = self.rows, [], 0
        return rows


def _packed(sent, window: int, last: int, padding: float):
    end = array("I", [last]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(sent.value).ids, _Packer(window, padding, TaskContext.get().partitionId() << 32)
        kind = None

        def table() -> pa.RecordBatch:
            columns = zip(_COLUMNS, [kind, *_TYPES], zip(*packer.taken()))
            return pa.RecordBatch.from_pydict({name: pa.array(values, of) for name, of, values in columns})

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                packer.add(doc_id, ids + end)
                if packer.size > _SENT:
                    yield table()
        packer.close()
        if packer.rows:
            yield table()

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, last: int = END, padding: float = PADDING) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece of a document: the ids
    (binary, 4 bytes each, little-endian) from ``start`` stand at ``offset`` of a sequence of at most ``window`` ids.

    A document is the ids of its text and ``last`` after them. Needs doc_id and text; other columns are not looked
    at. ``vocabulary`` is the path of a file of the tokenizers library on the driver; its few megabytes are broadcast.
    A null or empty text is ``last`` alone. Repeated rows are packed each, as is a row without doc_id. Every id lies
    in one piece, offsets are gapless from 0, and sequence_id is unique but not gapless. A document is cut only
    where it is longer than a window, or where best-fit leaves more than ``padding`` of the room. Documents are packed
    with others of their partition, so nothing is shuffled, and each partition may end with a window that is not
    full: read tables in partitions of thousands of documents. An empty table gives no rows.
    """
    with open(vocabulary, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select("doc_id", "text")
    key = StructType([rows.schema["doc_id"]])
    schema = StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return rows.mapInArrow(_packed(sent, window, last, padding), StructType(key.fields + schema.fields))
