"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal numbers of words. Slot k lies at the golden-ratio point of k, and the
point falls into the range of one source among the sources' cumulative shares; so every stretch of the
schedule holds each source close to its share. The slots of a source are ranked, its documents are
shuffled by a hash and laid end to end, their words cut into blocks of a slot's length, and block r fills
the source's slot of rank r. Documents begin anew where the mix takes more than a source has.

The schedule counts blocks exactly: the few slots that a source has beyond its need (points and shares
differ by a few slots at most) go to the sources that lack some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from qscore.llm.common import WORD, hash63, n_words, packed, running, unpacked
from qscore.operators.fetch import parted
from qscore.shared import materialize

WEIGHTS = (5, 2, 1)
_GRID = 42  # bits of a golden-ratio point
_STEP = round((1 << _GRID) * (5**0.5 - 1) / 2) | 1
_LOW = 20
_BIN = 1024


def recipe(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets: source, source_size and n (order of the source), to target.

    ``share`` of all words is divided by weight; no source gets over ``most`` times its size, and what
    it can't take goes to the others by weight, until none is above. Sources are in order of their code
    points, null last, and take the weights in turn. One row per source: a mix names each of its
    sources, so a window over all of them is small.
    """
    everyone = Window.partitionBy()
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("n", F.row_number().over(ordered) - 1)
    cycle = F.expr("array(" + ",".join(map(str, weights)) + ")")
    out = out.withColumn("_w", F.element_at(cycle, (F.col("n") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumn("_cap", F.col("source_size").cast("double") * most)
    # Sources reach their caps in order of cap by weight. With the first of them at their caps, the
    # rest share what is left; those stay below their caps from the first place on where that holds.
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "n")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("_all", F.sum("source_size").over(everyone) * F.lit(float(share)))
    out = out.withColumn(
        "_level",
        (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward),
    )
    out = out.withColumn("_place", F.row_number().over(up))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_place", "_level"))
    out = out.withColumn("_final", F.min(fits).over(everyone)["_level"])
    target = F.coalesce(F.least("_cap", F.col("_final") * F.col("_w")), F.col("_cap"))
    return out.select("source", "source_size", F.col("n").cast("int"), target.alias("target"))


def schedule(spark: SparkSession, needs: DataFrame) -> DataFrame:
    """(n, rank, slot) for each of the ``blocks`` blocks of each source n; slots from 0, without gaps."""
    ordered = Window.partitionBy(F.lit(0)).orderBy("n")
    needs = needs.select(
        "n", "blocks", (F.sum("blocks").over(ordered) - F.col("blocks")).alias("_from")
    ).where("blocks > 0")
    needs = materialize(needs, "mix-needs")
    total = needs.agg(F.sum("blocks")).first()[0] or 0
    ranges = needs.withColumn(
        "_bin",
        F.explode(F.expr(f"sequence(_from div {_BIN}, (_from + blocks - 1) div {_BIN})")),
    )
    # The point of k on a grid of 2^42 parts, in whole numbers: k is taken apart to keep products small.
    high, grid = (_STEP << _LOW) % (1 << _GRID), (1 << _GRID) - 1
    point = F.expr(
        f"((id >> {_LOW}) * {high}L % {1 << _GRID}L + (id & {(1 << _LOW) - 1}L) * {_STEP}L) & {grid}L"
    )
    slots = spark.range(total).withColumn("_at", F.floor(point / float(1 << _GRID) * float(total)))
    slots = slots.withColumn("_bin", F.expr(f"_at div {_BIN}"))
    fell = (
        slots.join(ranges, "_bin")
        .where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("blocks")))
        .select("id", "n", "blocks")
    )
    ranked = running(fell, "n", F.shiftright("id", 16), ["id"], F.lit(1))
    ranked = materialize(ranked.withColumnRenamed("_before", "rank"), "mix-slots")
    # As many slots are over as blocks are missing.
    by_number = lambda df, *order: df.withColumn(
        "_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    )
    over = by_number(ranked.where("rank >= blocks").select(F.col("id").alias("slot")), "slot")
    had = ranked.groupBy("n").agg(F.count(F.lit(1)).alias("_had"))
    missing = (
        needs.join(had, "n", "left")
        .withColumn("_had", F.coalesce("_had", F.lit(0)))
        .where("_had < blocks")
        .select("n", F.explode(F.expr("sequence(_had, blocks - 1)")).alias("rank"))
    )
    late = over.join(by_number(missing, "n", "rank"), "_i").select("n", "rank", "slot")
    return ranked.where("rank < blocks").select("n", "rank", F.col("id").alias("slot")).unionByName(late)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block: int = 4096,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The documents as the mix sees them, and the pieces that it takes.

    First: doc_id, size (words), source_size, target, n, at (place of the document in the shuffled
    source; with n, it tells documents with words apart), _id (hash of the row). Second: slot, n, rank,
    doc_id, at, epoch, first (word of the document, from 0) and words.

    Needs doc_id, text and source; no other column is looked at. A null text has no words, a null source
    is a source of its own, the last. Repeated rows are documents of their own. A document without words
    is never taken; an empty table gives empty results. Reruns give the same mix.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_id"))
    sized = materialize(sized, "mix-sizes")
    plan = recipe(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("quota", F.round("target").cast("long"))
    plan = materialize(plan.withColumn("blocks", F.expr(f"(quota + {block - 1}) div {block}")), "mix-plan")
    # The plan is read from its table, so that Spark knows its size when it chooses the join.
    known = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    known = known.drop("source", "_source").withColumn("_h", hash63(F.lit(seed), "doc_id", "_id"))
    placed = running(known, "n", F.shiftright("_h", 53), ["_h", "doc_id"], F.col("size"))
    placed = materialize(placed.withColumnRenamed("_before", "at").drop("_h"), "mix-places")

    start = F.col("at") + F.col("epoch") * F.col("source_size")
    taken = (
        placed.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("_from", start)
        .withColumn("_to", F.least(start + F.col("size"), F.col("quota")))
        .where("_from < _to")
        .withColumn("rank", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
        .withColumn("_a", F.greatest("_from", F.col("rank") * block))
        .withColumn("_b", F.least("_to", (F.col("rank") + 1) * block))
        .select(
            "n", "rank", "doc_id", "at", "epoch",
            (F.col("_a") - F.col("_from")).alias("first"), (F.col("_b") - F.col("_a")).alias("words"),
        )
    )
    pieces = taken.join(schedule(spark, plan), ["n", "rank"])
    seen = placed.select("doc_id", "size", "source_size", "target", "n", "at", "_id")
    return seen, pieces


def taken_words(seen: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: how many words of the document the mix takes."""
    sums = pieces.groupBy("n", "at").agg(F.sum("words").alias("taken"))
    sums = sums.withColumn("_has", F.lit(True))
    return (
        seen.withColumn("_has", F.col("size") > 0)
        .join(sums, ["n", "at", "_has"], "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row for each time that a document is
    taken, cut to the words taken where the mix ends inside it (words then stand one space apart).

    A column n_chars is counted anew for a document that is cut. Nulls, repeated rows and empty tables: see
    :func:`mix`.
    """
    needed = ["doc_id", "text", "source", *[c for c in docs.columns if c == "n_chars"]]
    seen, pieces = mix(docs, **settings)
    times = pieces.groupBy("n", "at", "doc_id", "epoch").agg(
        F.min("first").alias("_first"), F.sum("words").alias("_words")
    )
    times = times.join(seen.where("size > 0").select("n", "at", "_id", "size"), ["n", "at"])
    # Rows that repeat a document are numbered on both sides, so that each finds its own.
    copy = Window.partitionBy("doc_id", "_id", "epoch").orderBy("n", "at")
    times = times.withColumn("_copy", F.row_number().over(copy)).drop("n", "at", "epoch")
    times = times.groupBy("doc_id", "_id", "_copy").agg(
        F.collect_list(F.struct("_first", "_words", "size")).alias("_times")
    )
    # Rows without words are never taken, and may be very many of one key. Of the others, only those that repeat move to be numbered.
    worded = packed(docs, needed).where(F.col("text").rlike(WORD)).withColumn("_id", F.xxhash64("text"))
    repeated = seen.where("size > 0").groupBy("doc_id", "_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    single, several = parted(worded, materialize(repeated.drop("_n"), "mix-repeated"), ("doc_id", "_id"))
    number = F.row_number().over(Window.partitionBy("doc_id", "_id").orderBy(F.xxhash64("source")))
    numbered = single.withColumn("_copy", F.lit(1)).unionByName(several.withColumn("_copy", number))
    same = [numbered[c].eqNullSafe(times[c]) for c in ("doc_id", "_id", "_copy")]
    out = numbered.join(times, same).withColumn("_time", F.explode("_times"))
    part = F.array_join(
        F.slice(
            F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            (F.col("_time._first") + 1).cast("int"),
            F.col("_time._words").cast("int"),
        ),
        " ",
    )
    cut = F.col("_time._words") < F.col("_time.size")
    out = out.withColumn("text", F.when(cut, part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    kept = out.select(*[F.col(c) if c in ("text", "n_chars") else numbered[c] for c in needed], "__rest")
    return kept.select(*unpacked(docs.columns, needed))
