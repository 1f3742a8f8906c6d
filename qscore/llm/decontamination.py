"""Decontamination by spaced-seed hashing.

A seed is the hash of some of the words in a window: a fixed mask says which, and the words that it leaves
out may differ. Windows of documents and of benchmark items whose seeds are equal are laid on top of each
other, and a document is contaminated where, around such a hit, enough words are equal place by place.

Documents are read once, and nothing of them is shuffled but the surroundings of hits: the distinct seeds
of the benchmark are sent to the tasks if they are few enough, which is looked up first. Seeds that very many
hits share are salted. A hit and a benchmark window are compared as one number with a bit for each equal word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from qscore.llm.common import packed, unpacked
from qscore.operators.fetch import without
from qscore.operators.skew import join_few
from qscore.shared import materialize

#: Two masks of weight five: of 13 equal words of 16, or four fifths of 12 to 15, one of them always hits.
MASKS = ("101111", "1110011")
_LOOSE = 12  # an item of fewer words is searched for as it is
_AROUND = 16
_PLACES = 44  # of a window: _AROUND on both sides, and the longest item without a full stretch
_TOKEN = r"[\p{L}\p{N}]+"
_FEW = 1_000_000  # distinct seeds: 8 MB and more are not broadcast


def _hashes(text: str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: str, mask: str) -> Column:
    return F.greatest(F.size(words) - (len(mask) - 1), F.lit(0))


def _seeds(words: str, masks: tuple[str, ...]) -> Column:
    """Seeds of all windows, by mask and then by place; a text too short for any mask is a seed as a whole."""

    def of(number: int, mask: str) -> Column:
        kept = [i for i, m in enumerate(mask) if m == "1"]
        found = F.transform(
            F.sequence(F.lit(0), F.size(words) - len(mask)),
            lambda p: F.xxhash64(F.lit(number), *[F.get(F.col(words), p + i if i else p) for i in kept]),
        )
        return F.when(F.size(words) >= len(mask), found).otherwise(F.array().cast("array<bigint>"))

    found = F.concat(*[of(i, m) for i, m in enumerate(masks)])
    short, none = F.size(words) < min(map(len, masks)), F.size(words) == 0
    return F.when(none, F.array().cast("array<bigint>")).when(short, F.array(F.xxhash64(F.lit(len(masks)), words))).otherwise(found)


def _hits(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """One row for each window and mask: seed and place; other columns stay."""
    rows = rows.withColumn("_seeds", _seeds("words", masks))
    # Not posexplode: Spark would look first for rows without seeds, and make the words anew for every seed.
    rows = rows.select("*", F.posexplode_outer("_seeds").alias("_i", "seed")).drop("_seeds").where("seed is not null")
    place, before = F.col("_i"), F.lit(0)
    for mask in masks[:-1]:
        before = before + _windows("words", mask)
        place = F.when(F.col("_i") < before, place).otherwise(F.col("_i") - before)
    return rows.withColumn("place", place.cast("int")).drop("_i")


def _surroundings(outside: int) -> Column:
    """The words around a place; ``outside`` stands for those beyond the ends of the text."""
    return F.transform(
        F.sequence(F.lit(-_AROUND), F.lit(_PLACES - _AROUND - 1)),
        lambda o: F.coalesce(F.get(F.col("words"), F.col("place") + o), F.lit(outside).cast("long")),
    )


def _found(texts: DataFrame, seeds: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(text_hash, seed, place, doc_words) of the windows of ``texts`` (text_hash, words) that have a seed in ``seeds``."""
    hits = _hits(texts, masks)
    if seeds.count() <= _FEW:
        hits = hits.join(F.broadcast(seeds), "seed", "left_semi")
    else:
        # The words of a text follow once, not with each of its windows.
        hits = hits.drop("words").join(seeds, "seed", "left_semi").groupBy("text_hash").agg(F.collect_set(F.struct("seed", "place")).alias("hits"))
        hits = texts.join(hits, "text_hash").select("text_hash", "words", F.explode("hits").alias("hit")).select("text_hash", "words", "hit.*")
    return hits.select("text_hash", "seed", "place", _surroundings(0).alias("doc_words"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, stretch: int = 16, equal: int = 13, masks: tuple[str, ...] = MASKS
) -> DataFrame:
    """(doc_id, text_hash, item_id, equal_words, at): the documents that hold part of a benchmark item.

    A hit counts when ``equal`` of ``stretch`` places in a row are equal words; of an item shorter than
    ``stretch``, four fifths of its words; of one of fewer than 12 words, all of them in a row; of one of fewer than
    6, which chance would find, all of them and nothing else. Words are runs of letters and digits, in lower case.
    Named is the item with the most equal words around a hit, the smallest item_id among equals, and the first
    word (from 0) of the document's window with such a hit.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not looked at. Null
    and empty texts hold nothing and match nothing. Rows that repeat doc_id and text give one row. Items of equal
    words count as one, with the smallest item_id. A null doc_id is a document like any other. ``stretch`` is 16 at
    most; the masks hit every pattern that the thresholds given here count.
    """
    items = benchmark.select("item_id", _hashes("text").alias("words")).groupBy("words").agg(F.min("item_id").alias("item_id"))
    n = F.size("words")
    needed = F.when(n < _LOOSE, n).when(n < stretch, F.ceil(n * 0.8)).otherwise(F.lit(equal)).cast("int")
    items = _hits(items, masks).select("seed", "item_id", needed.alias("needed"), _surroundings(1).alias("item_words"))
    items = materialize(items.groupBy("seed", "item_words", "needed").agg(F.min("item_id").alias("item_id")), "item-seeds")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), _hashes("text").alias("words"))
    found = materialize(_found(texts, items.select("seed").distinct(), masks), "seed-hits")
    bits = [
        F.when(F.get("doc_words", F.lit(i)) == F.get("item_words", F.lit(i)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        for i in range(_PLACES)
    ]
    most = F.greatest(
        *[F.bit_count(F.col("_same").bitwiseAND(F.lit(((1 << stretch) - 1) << s).cast("long"))) for s in range(_PLACES - stretch + 1)]
    )
    pairs = join_few(found, items, "seed", ["text_hash", "place"])
    # Exploded, so that Spark does not put the whole comparison in each place that asks for its outcome.
    same = F.explode(F.array(reduce(lambda a, b: a.bitwiseOR(b), bits))).alias("_same")
    sure = (
        pairs.select("text_hash", "place", "item_id", "needed", same).where(most >= F.col("needed"))
        .withColumn("equal_words", F.bit_count("_same").cast("int"))
    )
    best = F.max_by(F.struct("item_id", "equal_words"), F.struct("equal_words", -F.col("item_id")))
    best = sure.groupBy("text_hash").agg(best.alias("_best"), F.min("place").alias("at"))
    best = materialize(best.select("text_hash", "_best.item_id", "_best.equal_words", "at"), "leaked-texts")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(best, "text_hash").distinct()
    return rows.select("doc_id", "text_hash", "item_id", "equal_words", "at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the contaminated ones; all columns and all other rows stay as they are, and none of them is
    shuffled but about one in a hundred."""
    gone = materialize(contaminated(docs, benchmark, **settings).select("doc_id", "text_hash"), "contaminated")
    keyed = packed(docs, ("doc_id", "text")).withColumn("text_hash", F.xxhash64("text"))
    return without(keyed, gone, ("doc_id", "text_hash")).select(*unpacked(docs.columns, ("doc_id", "text")))
