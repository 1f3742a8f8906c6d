"""Duplicated code and text.

A finding pairs a copy with the first of its group, never every copy with every other:
the output grows with the copies, not with their square. Groups of any size are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from qscore import constants as K
from qscore.functions import code
from qscore.functions.text import bind, collapse_space, once
from qscore.operators.fetch import likely
from qscore.operators.findings import function_segments
from qscore.operators.skew import join_few, spread_out
from qscore.shared import materialize


def duplicate_blocks(files: DataFrame, normal=code.normal_body, least_chars: int = 1) -> DataFrame:
    """Functions whose body equals that of an earlier one, with both locations.

    ``normal`` maps a body to what must be equal: white space collapsed, or
    :func:`qscore.functions.code.structure` for the same code under other names. Bodies
    shorter than ``least_chars`` are boilerplate. "Earlier" is by (repo, path, line).
    """
    # One pass over the files; the hashes are few and read twice below.
    blocks = materialize(
        function_segments(files)
        .select("repo", "path", "line_start", "line_end", once(body=normal(F.col("body"))))
        .where(F.length("body") >= least_chars)
        .withColumn("block", F.sha2(F.col("body").cast("binary"), 256))
        .drop("body"),
        "blocks",
    )
    groups = (
        blocks.groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("repo", "path", "line_start")).alias("first"),
        )
        .where("copies > 1")
    )
    paired = join_few(
        blocks, groups, "block", spread=("repo", "path", "line_start"),
        sizes=groups.select("block", "copies"), weight="copies",
    )
    here = F.struct("repo", "path", "line_start")
    return paired.where(here != F.col("first")).select(
        "repo",
        "path",
        "line_start",
        "line_end",
        F.col("first.repo").alias("first_repo"),
        F.col("first.path").alias("first_path"),
        F.col("first.line_start").alias("first_line"),
        "copies",
    )


def as_findings(duplicates: DataFrame) -> DataFrame:
    """Duplicates as report findings. They carry no severity and are kept out of scoring."""
    first = F.concat_ws(":", F.col("first_path"), F.col("first_line").cast("string"))
    return duplicates.select(
        "repo",
        F.lit("LOW").alias("priority"),
        F.lit(K.ARCHITECTURE).alias("pillar"),
        F.col("path").alias("location"),
        "line_start",
        "line_end",
        F.concat(F.lit("Same code as "), first).alias("description"),
        F.concat(F.lit("Move the shared code into one function and call it here and in "), first).alias(
            "remediation"
        ),
        F.lit(None).cast("string").alias("severity"),
    )


# ----------------------------------------------------------------------- near copies
WORDS = 5
SIMILAR = 0.8
# Common runs are learnt from this many texts at least, and from one text in ten of a larger corpus: a run is
# common at a count, not at a share, else pairs would grow with the square of the corpus. So many common runs are
# sent to the tasks (12 bytes each) at most. All this only sets the order in which runs are looked at; no result
# depends on it.
_SEEN_TEXTS, _SEEN_SHARE, _SEEN_TIMES, _COMMON_RUNS = 5_000, 10, 4, 1_000_000
# Words of 64 bits in a text's parities.
_PARITIES = 16
# Texts of one run that one task compares with as many others.
_BLOCK = 1_000
_EPSILON = 1e-9


def word_runs(text: Column, words: int = WORDS) -> Column:
    """Runs of ``words`` lower-case words, repeats included; a shorter text is one run."""
    return bind(
        F.split(collapse_space(F.lower(text)), " "),
        lambda tokens: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(tokens) - words, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i + 1, words), " "),
        ),
    )


def shingles(text: Column, words: int = WORDS) -> Column:
    return F.array_distinct(word_runs(text, words))


def run_hashes(text: Column, words: int = WORDS) -> Column:
    """The distinct runs of a text as 64-bit hashes: one hash per word, then one per run of those."""
    hashed = F.transform(F.split(collapse_space(F.lower(text)), " "), lambda w: F.xxhash64(w))
    return bind(
        hashed,
        lambda tokens: F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(tokens) - words, F.lit(0))),
                lambda i: F.xxhash64(F.slice(tokens, i + 1, words)),
            )
        ),
    )


def _common_runs(sets: DataFrame, firsts: DataFrame, n_texts: int) -> np.ndarray:
    """Runs in several texts of a sample, the most common last."""
    share = min(_SEEN_SHARE, max(1, -(-n_texts // _SEEN_TEXTS)))
    seen = sets.where(F.pmod(F.xxhash64("_hash", F.lit(1)), F.lit(share)) == 0).join(firsts, firsts.columns, "left_semi")
    counts = seen.select(F.explode("_runs").alias("_run")).groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.where(F.col("_n") >= _SEEN_TIMES).orderBy(F.desc("_n"), "_run").limit(_COMMON_RUNS)
    return common.select("_run").toArrow()["_run"].to_numpy()[::-1]


def _sketch(common: np.ndarray, spark, similar: float):
    """Of a text's n runs the n - ceil(similar * n) + 1 rarest, rarest first (two texts of that similarity share one
    of them at least, whatever order all texts agree on), and parities: by how many of its runs each of some bits
    is set, odd or even. Two texts' parities differ in no more bits than runs are in only one of them."""
    order = np.argsort(common, kind="stable")
    sent = spark.sparkContext.broadcast((common[order], order.astype(np.int32)))

    @F.pandas_udf("_rare array<bigint>, _bits array<bigint>")
    def sketch(sets: pd.Series) -> pd.DataFrame:
        known, rank = sent.value
        rare, bits = [], []
        for runs in sets:
            runs = np.sort(np.asarray(runs, np.int64))
            odd = np.bincount(runs & (64 * _PARITIES - 1), minlength=64 * _PARITIES) & 1
            bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            most = len(runs) - math.ceil(similar * len(runs) - _EPSILON) + 1
            if len(known):
                at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                runs = runs[np.argsort(np.where(known[at] == runs, rank[at] + 1, 0), kind="stable")]
            rare.append(runs[:most])
        return pd.DataFrame({"_rare": pd.Series(rare, dtype=object), "_bits": pd.Series(bits, dtype=object)})

    return sketch


def _blocks(shared: DataFrame, key: str) -> DataFrame:
    """Pairs of rows that share a run, the smaller key first. A run of many texts is cut into blocks of about
    ``_BLOCK`` texts, and every pair of blocks is one group of its own."""
    block = F.pmod(F.xxhash64(key, F.lit(2)), F.col("_blocks")).cast("int")
    dealt = shared.withColumn("_i", block)

    def side(name: str, row: Column, column: Column) -> DataFrame:
        return dealt.select(
            "_run", row.alias("_row"), column.alias("_column"),
            F.struct(F.col(key).alias("id"), F.col("_size").alias("n"), F.col("_at").alias("at")).alias(name),
        )

    one = side("_a", F.col("_i"), F.explode(F.sequence(F.col("_i"), F.col("_blocks") - 1)))
    other = side("_b", F.explode(F.sequence(F.lit(0), F.col("_i"))), F.col("_i"))
    pairs = one.join(other, ["_run", "_row", "_column"])
    # In a block's group with itself a pair would come twice.
    once_each = (F.col("_row") < F.col("_column")) | (F.col("_a.id") < F.col("_b.id"))
    return pairs.where(once_each & (F.col("_a.id") != F.col("_b.id"))).select(
        F.least(F.col("_a.id"), F.col("_b.id")).alias("_first"),
        F.greatest(F.col("_a.id"), F.col("_b.id")).alias(key),
        F.col("_a.n").alias("_n_a"), F.col("_b.n").alias("_n_b"),
        F.least(F.col("_a.n") - F.col("_a.at"), F.col("_b.n") - F.col("_b.at")).alias("_left"),
    )


def near_duplicates(
    texts: DataFrame, key: str = "doc_id", column: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """(key, first_<key>, jaccard): all pairs of different texts whose word-run sets are ``similar``, and
    every further copy of a text with its first copy.

    Each text stands for its copies under their least key; the pairs are pairs of those. The result is
    complete: texts meet on their rarest runs (of n runs, the n - ceil(similar n) + 1 that are rarest), on
    one of which every similar pair agrees. Pairs whose sizes, places in that order or parities rule the
    similarity out go before any set of runs is fetched; the others are compared on the whole sets, and only sets of
    such pairs move. Runs are 64-bit hashes; texts never move. Keys are unique; a null text or key is left out. An empty text is one empty run.
    """
    spark = texts.sparkSession
    present = texts.where(F.col(column).isNotNull() & F.col(key).isNotNull())
    # One pass over the texts; its result is read several times below.
    sketches = materialize(
        spread_out(present, key).select(
            key,
            F.sha2(F.col(column).cast("binary"), 256).alias("_hash"),
            once(_runs=run_hashes(F.col(column))),
        ),
        "sketches",
    )
    groups = materialize(
        sketches.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")), "text-groups"
    )
    copies = (
        join_few(
            sketches.select(key, "_hash"),
            groups.where("_n > 1").select("_hash", "_first"),
            "_hash",
            spread=(key,),
            sizes=groups.select("_hash", "_n"),
        )
        .where(F.col(key) != F.col("_first"))
        .select(key, F.col("_first").alias(f"first_{key}"), F.lit(1.0).alias("jaccard"))
    )
    # Of whole sets only the sampled ones move here; what is dropped of copies is their short sketches.
    firsts = groups.select(F.col("_first").alias(key))
    sketch = _sketch(_common_runs(sketches, firsts, groups.count()), spark, similar)
    short = sketches.select(key, F.size("_runs").alias("_size"), sketch("_runs").alias("_s")).select(key, "_size", "_s.*")
    short = materialize(short.join(firsts, key, "left_semi"), "rare-runs")
    index = short.select(key, "_size", F.posexplode("_rare").alias("_at", "_run"))
    met = index.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = materialize(met.withColumn("_blocks", F.ceil(F.col("_n") / _BLOCK).cast("int")), "shared-runs")
    shared = join_few(index, met.select("_run", "_blocks"), "_run", spread=(key,), sizes=met.select("_run", "_n"))
    least = F.lit(similar / (1 + similar)) * (F.col("_n_a") + F.col("_n_b")) - _EPSILON
    near_in_size = F.least("_n_a", "_n_b") >= F.greatest("_n_a", "_n_b") * similar - _EPSILON
    candidates = materialize(
        _blocks(shared, key).where(near_in_size & (F.col("_left") >= least)).select(key, "_first").distinct(),
        "candidates",
    )

    def fetched(rows: DataFrame, by: str, found: DataFrame) -> DataFrame:
        sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
        return join_few(rows, found, by, spread=(key, "_first"), sizes=sizes)

    def parities(by: str, size: str, name: str) -> DataFrame:
        return short.select(F.col(key).alias(by), F.col("_size").alias(size), F.col("_bits").alias(name))

    marked = fetched(fetched(candidates, key, parities(key, "_n_a", "_p")), "_first", parities("_first", "_n_b", "_q"))
    unlike = F.aggregate(F.zip_with("_p", "_q", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    most = F.lit((1 - similar) / (1 + similar)) * (F.col("_n_a") + F.col("_n_b")) + 1e-6
    close = materialize(marked.where(unlike <= most).select(key, "_first").distinct(), "close-candidates")
    wanted = materialize(close.select(F.explode(F.array(key, "_first")).alias(key)).distinct(), "close-texts")
    whole = likely(sketches.select(key, "_runs"), wanted, (key,))

    def sets_of(by: str, name: str) -> DataFrame:
        return whole.select(F.col(key).alias(by), F.col("_runs").alias(name))

    pairs = fetched(fetched(close, key, sets_of(key, "_one")), "_first", sets_of("_first", "_other"))
    both = F.size(F.array_intersect("_one", "_other"))
    near = pairs.select(
        key,
        F.col("_first").alias(f"first_{key}"),
        once(jaccard=bind(both, lambda n: n / (F.size("_one") + F.size("_other") - n))),
    ).where(F.col("jaccard") >= similar)
    return near.withColumn("jaccard", F.round("jaccard", 6)).unionByName(copies)
