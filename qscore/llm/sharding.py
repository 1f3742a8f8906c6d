"""Sharding by histogram sort: equal bytes per shard, copies of a text side by side.

Documents are ordered by a hash of the text and then by a hash of doc_id. The cuts between shards
are searched for with exact counts: every round lays 512 probes over the key range that holds a cut,
sums the bytes between neighbouring probes in one pass over a narrow table of keys, and goes on in
the one range between two probes that holds the cut. When all cuts are near enough to their targets,
rows are dealt out once. Sums of at most 512 ranges per cut reach the driver, whatever the input.

A cut lies between two texts if it can: copies of a text are parted only where keeping them together
would move the cut by more than the tolerance and by more than half of the largest document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from qscore.llm.common import hash63, packed, running, unpacked
from qscore.shared import materialize

OVERHEAD = 16  # bytes that a row takes besides its text
_BITS, _STEP = 63, 9


@dataclass
class _Cut:
    """A cut being searched for: ``prefix`` of the range that holds it, and the bytes before that."""

    target: float
    prefix: int = 0
    before: int = 0
    group: int | None = None
    at: tuple[int, int] | None = None


def size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and the overhead of a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _sums(keys: DataFrame, column: str, level: int, cuts: list[_Cut]) -> dict[tuple, list]:
    """Bytes between the probes of this level, by the range that is open: (digit, bytes, lo, hi)."""
    open_ = F.shiftright(column, _BITS - _STEP * level)
    digit = F.shiftright(column, _BITS - _STEP * (level + 1))
    if column == "_d":
        by, wanted = F.col("_g"), F.col("_g").isin(sorted({c.group for c in cuts}))
    else:
        by, wanted = F.lit(None).cast("long"), F.lit(True)
    if level:
        wanted &= open_.isin(sorted({c.prefix for c in cuts}))
    rows = (
        keys.where(wanted)
        .groupBy(by.alias("group"), digit.alias("digit"))
        .agg(F.sum("_size").alias("bytes"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        .collect()
    )
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["digit"]):
        found.setdefault((r["group"], r["digit"] >> _STEP), []).append(r)
    return found


def _search(keys: DataFrame, column: str, cuts: list[_Cut], tolerance: float, grain: float) -> list[_Cut]:
    """Settles the cuts; returns those that fall into one text that is too large to move around."""
    inside: list[_Cut] = []
    for level in range(_BITS // _STEP):
        if not cuts:
            break
        shift = _BITS - _STEP * (level + 1)
        sums = _sums(keys, column, level, cuts)
        further = []
        for cut in cuts:
            before = cut.before
            for r in sums[cut.group, cut.prefix]:
                if before + r["bytes"] >= cut.target:
                    break
                before += r["bytes"]
            low, high = cut.target - before, before + r["bytes"] - cut.target
            edge = (r["digit"] + (low > high)) << shift
            single = r["lo"] == r["hi"]
            if min(low, high) <= (max(tolerance, grain) if single else tolerance) or (
                single and column == "_d"
            ):
                cut.at = (edge, 0) if column == "_g" else (cut.group, edge)
            elif single:
                inside.append(_Cut(cut.target, 0, before, r["lo"]))
            else:
                cut.prefix, cut.before = r["digit"], before
                further.append(cut)
        cuts = further
    return inside


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """First keys (text hash, doc hash) of the shards 1, 2, ...; a shard without a key is left out."""
    total, largest = keys.agg(F.sum("_size"), F.max("_size")).first()
    if not total:
        return []
    cuts = [_Cut(total * i / shards) for i in range(1, shards)]
    slack = tolerance * total / shards
    inside = _search(keys, "_g", list(cuts), slack, largest / 2)
    _search(keys, "_d", list(inside), slack, largest / 2)
    return sorted(c.at for c in [*cuts, *inside] if c.at and c.at[0] < 1 << _BITS)


def _place(at: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below a row's key. A table over the first bits of the key names the few
    splitters that remain to be compared."""
    if not at:
        return F.lit(0)
    head = _BITS - _STEP
    heads = [g >> head for g, _ in at]
    below = [sum(h < i for h in heads) for i in range(1 << _STEP)]
    among = [heads.count(i) for i in range(1 << _STEP)]
    texts = [",".join(map(str, x)) for x in (below, among)]
    low, n = (
        F.element_at(F.expr(f"array({t})"), (F.shiftright("_g", head) + 1).cast("int")) for t in texts
    )
    known = F.expr(
        "array(" + ",".join(
            f"named_struct('g', {g}L, 'd', {'9223372036854775807' if d >= 1 << _BITS else d}L)"
            for g, d in at
        ) + ")"
    )
    key = F.struct(F.col("_g").alias("g"), F.col("_d").alias("d"))
    return (low + F.size(F.filter(F.slice(known, low + 1, n), lambda s: s <= key))).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, cells: int = 16) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0 in a shard) and ``size``.

    Needs doc_id and text; other columns pass through, but for columns of those three names, which are
    replaced. Bytes per shard are equal up to ``tolerance`` (of a shard) on either side, or up to half
    of a document where documents are larger than that. A null text counts as empty, a null doc_id is
    an id like any other. Rows that repeat both doc_id and text stay in one shard. An empty table
    gives no rows; with fewer documents than shards, some shards stay empty. ``cells`` cuts a shard for
    numbering its rows; it changes nothing but the plan and the order of the slots.
    """
    needed = ("doc_id", "text")
    keyed = packed(docs, needed).withColumns(
        {
            "_g": hash63(F.coalesce("text", F.lit(""))),
            "_d": hash63("doc_id"),
            "_size": size(),
        }
    )
    keys = materialize(keyed.select("_g", "_d", "_size"), "shard-keys")
    placed = keyed.withColumn("shard", _place(splitters(keys, shards, tolerance)))
    numbered = running(placed, "shard", F.pmod("_d", F.lit(cells)), ["_g", "_d", "doc_id"], F.lit(1))
    return numbered.select(
        *unpacked(docs.columns, needed, ("size", "shard", "slot")),
        F.col("_size").alias("size"), "shard", F.col("_before").cast("long").alias("slot"),
    )
