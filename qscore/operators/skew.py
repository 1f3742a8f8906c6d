"""Joins and windows that stay balanced when one key holds a large part of all rows.

A key is *hot* when it has more than one ``_PARTS``-th of all rows. By arithmetic there
are fewer than ``_PARTS`` hot keys whatever the data, so a table of them may be
broadcast; no other table is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from qscore.shared import materialize

_PARTS = 10_000
# Buckets of keys that are counted to find hot keys: most buckets are far below the share of a hot key.
_BUCKETS = 65_536
# Below this many rows a key is never worth splitting.
_MIN_ROWS = 100_000


def spread_out(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` on all cores before work that is costly for each row: a scan that has fewer partitions than there are
    cores, as of one small file, is dealt out; any other is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *by) if rows.rdd.getNumPartitions() < cores else rows


def hot_keys(sizes: DataFrame, weight: str, min_rows: int = _MIN_ROWS) -> DataFrame:
    """Rows of ``sizes`` (one per key) whose ``weight`` is above 1/10,000 of the sum."""
    total = sizes.agg(F.sum(weight)).scalar()
    heavy = F.col(weight)
    return sizes.where((heavy > min_rows) & (heavy * _PARTS > total))


def hot_groups(
    rows: DataFrame, keys: Sequence[str], weight: Column | None = None, min_rows: int | None = None
) -> DataFrame | None:
    """The hot ``keys`` of ``rows``, or None where no key is hot; ``weight`` (default 1) counts for a row.

    Rows are counted by buckets of keys, which hardly shuffles anything; only the keys of buckets that are heavy
    enough to hold a hot key are counted themselves. ``rows`` are read at once, so written ones are best.
    """
    least = _MIN_ROWS if min_rows is None else min_rows
    one = F.lit(1) if weight is None else weight
    marked = rows.select(*keys, one.alias("_n"), F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).alias("_bucket"))
    buckets = marked.groupBy("_bucket").agg(F.sum("_n").alias("_n")).collect()
    total = sum(b["_n"] for b in buckets)
    heavy = [b["_bucket"] for b in buckets if b["_n"] > least and b["_n"] * _PARTS > total]
    if not heavy:
        return None
    held = marked.join(F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in heavy], "_bucket long")), "_bucket")
    sizes = held.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    hot = materialize(sizes.where((F.col("_n") > least) & (F.col("_n") * _PARTS > total)).select(*keys), "hot-keys")
    return hot if hot.take(1) else None


def parted(rows: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose keys are not in ``hot`` (see :func:`hot_groups`), and the others."""
    named = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
    marked = rows.join(F.broadcast(named), same, "left")
    return marked.where("_hot is null").select(*rows.columns), marked.where("_hot").select(*rows.columns)


def following(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: a struct of ``columns`` of the next row of the key in the order of ``order`` (total within a
    key), null for the last one. Rows of hot keys are numbered over ranges and meet the next number. ``rows`` are
    read more than once."""

    def plain(some: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return some.withColumn(name, F.lead(F.struct(*columns)).over(window))

    hot = hot_groups(rows, keys)
    if hot is None:
        return plain(rows)
    cold, few = parted(rows, keys, hot)
    others = [c for c in rows.columns if c not in keys]
    numbered = positions(few.select(F.struct(*keys).alias("_key"), *others), "_key", order, "_nth")
    numbered = materialize(numbered.select("_key.*", "_key", *others, "_nth"), "numbered")
    later = numbered.select("_key", (F.col("_nth") - 1).alias("_nth"), F.struct(*columns).alias(name))
    met = numbered.join(later, ["_key", "_nth"], "left").select(*rows.columns, name)
    return plain(cold).unionByName(met)


def join_few(
    rows: DataFrame,
    keyed: DataFrame,
    on: str | Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    sizes: DataFrame | None = None,
    weight: str = "_n",
    min_rows: int = _MIN_ROWS,
) -> DataFrame:
    """Join many ``rows`` with few rows per key (``keyed``); ``how`` is inner, left or left_semi.

    Rows of a hot key get one of several salts, from a hash of ``spread`` (columns that
    tell the rows of one key apart), and the few rows of that key are repeated once per
    salt. All splits together are below 2 x 10,000, so the repeated side stays small.
    ``sizes`` (key columns and ``weight``) saves the count over ``rows``.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
    total = sizes.agg(F.sum(weight)).scalar()
    hot = hot_keys(sizes, weight, min_rows).select(
        *keys, F.ceil(F.col(weight) * _PARTS / total).cast("int").alias("_splits")
    )
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_splits")), F.lit(0))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int"))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    repeated = keyed.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(salts)
    )
    joined = salted.drop("_splits").join(repeated.drop("_splits"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def first_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    spread: Sequence[str | Column],
    only: DataFrame | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each key, in two steps.

    Each of 1,024 shares of a key first drops what cannot be among the first rows, so no
    task ever sorts all rows of a key. ``only`` restricts the keys; it is applied between
    the steps, when no key has many rows left. Rows are dealt out explicitly, as a window
    would accept rows that already lie together by key.
    """
    share = F.pmod(F.xxhash64(*spread), F.lit(1024))
    local = Window.partitionBy(*keys, "_share").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        rows.withColumn("_share", share)
        .repartition(*keys, "_share")
        .withColumn("_rn", F.row_number().over(local))
        .where(F.col("_rn") <= limit)
        .drop("_share", "_rn")
    )
    if only is not None:
        cut = cut.join(only.select(*keys), list(keys), "left_semi")
    return (
        cut.withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= limit)
        .drop("_rn")
    )


def positions(rows: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds ``name``: the place of a row within its key, from 1, in the order of ``order``.

    Rows are sorted over ranges of (key, order) and written; places follow from the counts of the ranges, so
    that no task sorts all rows of a key. Rows equal in ``order`` have their places in any order.
    """
    placed = materialize(
        rows.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
        "positions",
    )
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        parts.select(
            F.col(key).alias("_k"), F.col("_part").alias("_p"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_shift"),
        ),
        "position-starts",
    )
    same = placed[key].eqNullSafe(starts["_k"]) & (placed["_part"] == starts["_p"])
    return placed.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def running_sum(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of a key up to this one, in the order of ``order`` (total
    within a key).

    Rows are written; where no key is hot, one window follows. The rows of hot keys are sorted over ranges of
    (keys, order) and written, so that no task holds all rows of a key. Few keys cross from one range into the
    next, at most one for each range, so what they bring along is broadcast.
    """
    rows = materialize(rows, "summands")
    hot = hot_groups(rows, keys)
    cold, few = (rows, None) if hot is None else parted(rows, keys, hot)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = cold.withColumn(name, F.sum(value).over(upto))
    return plain if few is None else plain.unionByName(_ranged_sum(few, keys, order, value, name))


def _ranged_sum(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    placed = materialize(
        rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running-sums"
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = (
        placed.groupBy(*keys, "_part")
        .agg(F.sum(value).alias("_sum"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_part").alias("_p"),
            F.sum("_sum").over(before).alias("_brought"),
        )
        .where("_brought is not null")
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # Dealt out explicitly: a window would accept rows that already lie together by key.
    own = placed.repartition(*keys, "_part").withColumn(name, F.sum(value).over(within))
    return own.join(F.broadcast(brought), same, "left").select(
        *rows.columns, (F.col(name) + F.coalesce("_brought", F.lit(0))).alias(name)
    )


def trailing_window(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    depth: int,
    measures: dict[str, Callable[[WindowSpec], Column]],
    min_rows: int = _MIN_ROWS,
) -> DataFrame:
    """Window measures over the current and the ``depth`` rows before it, per key.

    ``order`` is a total order within a key; ``measures`` maps a name to a function of the window spec. The
    rows of a hot key are numbered in that order and cut into ranges of ``min_rows``, whatever their values; each
    range borrows the ``depth`` rows before it, so the result is that of one window over the whole key.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(sizes, "_n", min_rows).select(F.col(key).alias("_k"), F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), rows[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    others = marked.where("_hot is null").select(*rows.columns, F.lit(0).cast("long").alias("_range"), F.lit(True).alias("_own"))
    own, last = (F.expr(f"(_at - 1 + {more}) div {min_rows}") for more in (0, depth))
    numbered = positions(marked.where("_hot").drop("_hot"), key, order, "_at")
    cut = numbered.select(*rows.columns, own.alias("_first"), F.explode(F.sequence(own, last)).alias("_range"))
    cut = cut.select(*rows.columns, "_range", (F.col("_range") == F.col("_first")).alias("_own"))
    window = Window.partitionBy(key, "_range").orderBy(*order)
    # Dealt out explicitly: a window would accept rows that already lie together by key.
    out = others.unionByName(cut).repartition(key, "_range")
    for name, measure in measures.items():
        out = out.withColumn(name, measure(window))
    return out.where("_own").drop("_range", "_own")
