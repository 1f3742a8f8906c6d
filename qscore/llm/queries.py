"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from qscore.llm import chat, decontamination, embeddings, merkle, mixing, packing, quality, sharding, simhash, substrings, suffixes, toxicity, whitening
from qscore.llm.common import load
from qscore.llm.samples import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), radius=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    one_more = spark.sql(
        f"select * from values (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) t(conv_id, turn, role, text)"
    )
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one_more)
    turns, loss = chat.read_back(F.col("formatted")), chat.under_loss(F.col("formatted"), F.col("loss"))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        chat.format_trees(chat.from_turns(rows))
        .withColumns({"_turns": turns, "_loss": loss})
        .select(
            F.col("tree").alias("conv_id"),
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


@query
def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard_documents(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix(load(spark, sf_dir, "documents")))


@query
def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_earlier(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"), least=0.9)


@query
def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def _scored(scored: DataFrame, column: str, held_out, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col(column).alias("score"),
        (F.col(column) >= threshold).cast("int").alias("predicted"),
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = quality.learn_and_score(docs.select("doc_id", "text"), labels, ~held_out)
    return _scored(scored, "quality", held_out, 0.7)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = toxicity.learn_and_score(docs.select("doc_id", "text"), labels, ~held_out)
    return _scored(scored, "toxicity", held_out, 0.5)


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"), components=8)


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    told = F.coalesce(told, F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(load(spark, sf_dir, "documents"), "doc_id", "source", fields, {"text": told})
    folded = merkle.fold(F.col("told_leaf"), F.col("way"))
    return found.withColumn("folded", folded).select(
        "doc_id", *[F.col(c).cast("string").alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.proof(F.col("way")).cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").cast("string").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


@query
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
