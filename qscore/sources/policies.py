"""Policy files: one JSON document per organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qscore import schemas
from qscore.functions.strict_json import strict

_TEXTS = {
    ".gate.llm": (
        "provider", "base_url", "model_name", "auth_type", "api_key_env_var",
        "oauth_token_url", "oauth_auth_url", "oauth_client_id_env_var",
        "oauth_client_secret_env_var", "oauth_redirect_url", "oauth_token_cache_file",
    )
}

_LISTS = (".exclusions.paths", ".gate.llm.oauth_scopes")


def read_policies(spark: SparkSession, root: str) -> DataFrame:
    """(org, raw) from ``<root>/<org>/<any name>.json``."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .text(root, wholetext=True, recursiveFileLookup=True)
        .select(
            F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("org"),
            F.col("value").alias("raw"),
        )
    )


def flatten(raw_policies: DataFrame, key: str = "org") -> DataFrame:
    """Flat policies from (key, raw).

    Absent keys become zero values, not defaults: without ``target_threshold`` everything
    passes. The two privacy switches and the hard-fail switch stay null when absent.
    """
    p = raw_policies.select(key, strict(F.col("raw"), schemas.POLICY, _TEXTS, _LISTS).alias("p"))

    def text(name: str):
        return F.coalesce(F.col(f"p.gate.llm.{name}"), F.lit("")).alias(name)

    return p.select(
        key,
        F.col("p").isNotNull().alias("readable"),
        F.coalesce("p.gate.target_threshold", F.lit(0.0)).alias("target_threshold"),
        F.col("p.gate.fail_on_critical_security").alias("fail_on_critical_security"),
        F.col("p.gate.llm").isNotNull().alias("has_llm"),
        text("base_url"),
        text("model_name"),
        text("auth_type"),
        F.coalesce("p.gate.llm.timeout_ms", F.lit(0)).alias("timeout_ms"),
        F.coalesce("p.gate.llm.temperature", F.lit(0.0)).alias("temperature"),
        text("oauth_token_url"),
        text("oauth_auth_url"),
        text("oauth_client_id_env_var"),
        text("oauth_client_secret_env_var"),
        text("oauth_redirect_url"),
        F.col("p.gate.privacy.allow_public_cloud_transmission").alias(
            "allow_public_cloud_transmission"
        ),
        F.col("p.gate.privacy.data_scrubbing").alias("data_scrubbing"),
        F.coalesce("p.pillars.verification.mutation_coverage_floor", F.lit(0.0)).alias(
            "mutation_floor"
        ),
        F.col("p.exclusions.paths").alias("exclusion_paths"),
    )


def exclusion_patterns(policies: DataFrame, key: str = "org") -> DataFrame:
    """(key, pattern), one row per exclusion glob."""
    return policies.select(key, F.explode("exclusion_paths").alias("pattern"))
