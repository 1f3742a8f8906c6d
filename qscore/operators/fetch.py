"""Wide rows of wanted keys, or of all others, without a shuffle of those that a filter of keys rules out.

A blocked Bloom filter of the wanted keys is tested where the rows lie; a few rows pass by chance, so an exact join
follows. The filter is a table of bitmaps, one per block of keys; all bits of a key lie in one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Bits of one bitmap, as Spark's bitmap functions make them, and bits for each wanted key: with four
# positions per key about one row in a hundred passes by chance.
_BLOCK_BITS = 8 * 4096
_BITS_PER_KEY = 10
_POSITIONS = 4
# Bitmaps of 4 KB that are sent to every task at most (64 MB): enough for some 50 million keys; with more
# keys more rows pass by chance, and from half a billion on nearly all do.
_MOST_BLOCKS = 16_384


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(blocks)).cast("int")


def _position(keys: Sequence[str], i: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*keys, F.lit(2)), 15 * i), F.lit(_BLOCK_BITS))


def _hit(keys: Sequence[str]) -> Column:
    """Whether all positions of the keys are set in ``_bits``."""

    def is_set(i: int) -> Column:
        at = _position(keys, i)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        shifted = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int"))
        return shifted.bitwiseAND(F.lit(1)) == 1

    hit = is_set(0)
    for i in range(1, _POSITIONS):
        hit = hit & is_set(i)
    return hit


def key_filter(wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(block, bits) for the keys of ``wanted``, and the number of blocks. ``wanted`` is counted first, and a
    key that comes often counts as many, so reduce it to few rows per key before."""
    blocks = min(_MOST_BLOCKS, max(1, -(-wanted.count() * _BITS_PER_KEY // _BLOCK_BITS)))
    positions = F.array(*[_position(keys, i) for i in range(_POSITIONS)])
    bits = wanted.select(_block(keys, blocks).alias("_block"), F.explode(positions).alias("_position"))
    return bits.groupBy("_block").agg(F.bitmap_construct_agg("_position").alias("_bits")), blocks


def likely(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose ``keys`` are in ``wanted``, and a few others; an exact join must follow.

    ``rows`` are not shuffled. Where a key has another type in ``wanted`` than in ``rows`` equal values would
    have unequal hashes, so all rows pass. No wanted keys, no rows. Keys that are null may pass.
    """
    if any(rows.schema[k].dataType != wanted.schema[k].dataType for k in keys):
        return rows
    bitmaps, blocks = key_filter(wanted.select(*keys), keys)
    return (
        rows.withColumn("_block", _block(keys, blocks))
        .join(F.broadcast(bitmaps), "_block")
        .where(_hit(keys))
        .select(*rows.columns)
    )


def parted(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``keys`` are surely not in ``wanted``, and all others: those that are, nulls like any other key, and
    a few more. ``rows`` are not shuffled, and are read for each of the two. All are among the others where a key has another type."""
    if any(rows.schema[k].dataType != wanted.schema[k].dataType for k in keys):
        return rows.limit(0), rows
    bitmaps, blocks = key_filter(wanted.select(*keys), keys)
    marked = rows.withColumn("_block", _block(keys, blocks)).join(F.broadcast(bitmaps), "_block", "left")
    hit = F.coalesce(_hit(keys), F.lit(False))
    return marked.where(~hit).select(*rows.columns), marked.where(hit).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose ``keys`` are not in ``gone``; keys that are null on both sides are equal.

    Rows that the filter rules out stay where they lie, whatever the size of ``gone``; only the others, few more than go,
    meet ``gone`` in an exact join. ``rows`` and ``gone`` are evaluated twice.
    """
    stay, others = parted(rows, gone, keys)
    named = gone.select(*[F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_gone{i}"))
    return stay.unionByName(others.join(named, same, "left_anti"))
