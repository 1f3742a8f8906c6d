"""Code, policies, reviews and histories derived from the given tables.

The given tables hold no code, so the registered queries run on views over them. Each view
is a list of SQL expressions that Spark and the checking engine both understand; ``{S}``
is the string type. Only test data is made here: no operator depends on this module.
The two snapshots lack every 101st and every 97th key of the lines, so that files are added
and deleted between them; this is what the change operators are about, not a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# name -> (table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "code_lines": (
        "lineitem",
        [
            "l_orderkey % 2000 AS repo",
            """CASE l_orderkey % 7 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/vendor/lib/'
               WHEN 2 THEN 'a/node_modules/p/' ELSE 'src/' END
               || 'f' || CAST(l_orderkey AS {S}) ||
               CASE l_orderkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.Go'
               WHEN 3 THEN '.rs' WHEN 4 THEN '.go' ELSE '.sql' END AS path""",
            "l_linenumber AS ln",
            """CASE CAST(l_quantity AS INT) % 10
               WHEN 0 THEN 'func f' || CAST(l_linenumber AS {S}) || '() {'
               WHEN 1 THEN 'if ok {' WHEN 2 THEN 'for { if x {' WHEN 3 THEN '}' WHEN 4 THEN '} }'
               WHEN 5 THEN CASE WHEN l_partkey % 5 = 0
                 THEN 'password = "hunter' || CAST(l_partkey AS {S}) || '"' ELSE 'a := temp' END
               WHEN 6 THEN CASE WHEN l_partkey % 5 = 0
                 THEN 'apiKey := "sk-abcdef' || CAST(1000000 + l_partkey AS {S}) || '"' ELSE '    ' END
               WHEN 7 THEN CASE WHEN l_partkey % 5 = 0
                 THEN 'api_key: "k' || CAST(10000000 + l_partkey AS {S}) || '"' ELSE 'x = "{"' END
               WHEN 8 THEN 'switch { case { for { if {' ELSE 'return x' END AS line""",
            "l_orderkey AS okey",
            "l_partkey AS pkey",
        ],
    ),
    "policy_facts": (
        "nation",
        [
            "'org' || CAST(n_nationkey AS {S}) AS org",
            "n_nationkey AS k",
            """CASE n_nationkey % 5 WHEN 0 THEN CAST(150 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE)
               WHEN 2 THEN CAST(80 AS DOUBLE) WHEN 3 THEN CAST(99 AS DOUBLE) ELSE NULL END AS target_threshold""",
            """CASE n_nationkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END
               AS fail_on_critical_security""",
            """CASE n_nationkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END
               AS allow_public_cloud_transmission""",
            "CASE n_nationkey % 7 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END AS data_scrubbing",
            """CASE n_nationkey % 6 WHEN 0 THEN 'kerberos' WHEN 1 THEN '' WHEN 2 THEN 'oauth_browser'
               ELSE 'api_key' END AS auth_type""",
            """CASE n_nationkey % 5 WHEN 3 THEN '' ELSE 'https://models.example/' || CAST(n_nationkey AS {S})
               END AS base_url""",
            "'reviewer-' || CAST(n_nationkey % 3 AS {S}) AS model_name",
            "CAST(n_nationkey % 4 AS DOUBLE) / 10 AS temperature",
            "CASE WHEN n_nationkey >= 8 THEN 'https://auth.example/token' END AS oauth_token_url",
            "CASE WHEN n_nationkey >= 14 THEN 'https://auth.example/start' END AS oauth_auth_url",
            "CASE WHEN n_nationkey >= 20 THEN 'CLIENT_ID' END AS oauth_client_id_env_var",
            "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(50 + n_nationkey AS DOUBLE) END AS mutation_floor",
            "n_nationkey % 11 <> 10 AS with_llm",
            "n_nationkey <> 13 AS well_formed",
        ],
    ),
    "review_attempts": (
        "conversations",
        [
            "conv_id AS review_id",
            "turn + 1 AS attempt",
            """CASE (conv_id + turn * 3) % 5 WHEN 0 THEN 'I cannot evaluate this code, sorry.'
               WHEN 1 THEN '{"pillar_adjustments":{"static_health_deduction":999,"architecture_deduction":-5},"remediations":[]}'
               WHEN 2 THEN '{"pillar_adjustments":{"static_health_deduction":' || CAST(conv_id % 20 AS {S}) || '.5,"architecture_deduction":2.5},"remediations":[{"priority":"HIGH","pillar":"static","location":"main.go:lines 3-9","finding":"Poor function naming","actionable_fix":"Rename"}]}'
               WHEN 3 THEN '[1,2' ELSE CASE conv_id % 2 WHEN 0 THEN '{}'
                 ELSE '{"remediations":[{"finding":"Unclear flow"}]}' END END AS raw""",
        ],
    ),
    "test_quality": (
        "part",
        [
            "p_partkey % 2000 AS repo",
            "p_partkey AS suite",
            "p_partkey * 3 % 11 AS u",
            "p_partkey * 5 % 11 AS m",
            "p_partkey * 7 % 11 AS r",
            "p_partkey % 11 AS a",
            "p_partkey * 2 % 11 AS n",
            "p_partkey * 4 % 11 AS g",
            "p_partkey * 6 % 11 AS f",
            "p_partkey * 8 % 11 AS t",
            "CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS mutation_coverage",
        ],
    ),
    "score_history": (
        "events",
        [
            "user_id AS repo",
            "event_id",
            "ts",
            "CAST(CAST(floor(value * 4) AS BIGINT) % 201 AS DOUBLE) / 2 AS total",
        ],
    ),
    "changes": (
        "orders",
        [
            "o_custkey AS changeset",
            "'src/f' || CAST(o_orderkey AS {S}) || CASE o_orderkey % 4 WHEN 0 THEN '.go' ELSE '.md' END AS path",
            """CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 4 THEN '  ' || chr(10) || chr(9) ELSE '+x' END AS diff""",
        ],
    ),
    "diffs": (
        "lineitem",
        [
            "l_orderkey AS changeset",
            "l_linenumber AS part",
            """'--- a/f.go' || chr(10) || '+++ b/password = "x' || CAST(l_suppkey AS {S}) || CASE l_suppkey % 3 WHEN 0 THEN 'abc"' ELSE '' END
               || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-pwd: "removed' || CAST(l_partkey AS {S}) || '"'
               || chr(10) || CASE l_partkey % 4 WHEN 0 THEN '+pwd: "added' || CAST(l_partkey AS {S}) || '"'
                  WHEN 1 THEN ' secret = "context"' WHEN 2 THEN '+sk-' || md5(CAST(l_partkey AS {S})) ELSE '+return' END AS diff""",
        ],
    ),
    "commit_log": (
        "orders",
        [
            "o_custkey AS repo",
            "o_orderkey AS seq",
            """md5(CAST(o_orderkey AS {S})) || CASE o_orderkey % 9 WHEN 0 THEN ''
               ELSE ' order ' || o_orderpriority END AS log_line""",
        ],
    ),
    "commit_numbers": (
        "orders",
        [
            "o_custkey - o_custkey % 10 AS repo",
            "row_number() OVER (PARTITION BY o_custkey - o_custkey % 10 ORDER BY o_orderkey) AS n",
        ],
    ),
    # Branches from every third commit, a merge at every fifth, and a new root at every 29th.
    "commit_parents": (
        "commit_numbers",
        [
            "repo",
            "CAST(n AS BIGINT) AS n",
            "CAST(CASE WHEN n % 29 = 1 THEN NULL WHEN n % 3 = 0 THEN n - 2 ELSE n - 1 END AS BIGINT) AS p0",
            "CAST(CASE WHEN n % 29 = 1 THEN NULL WHEN n % 5 = 0 AND n > 9 THEN n - 4 WHEN n % 31 = 0 THEN n - 30 END AS BIGINT) AS p1",
        ],
    ),
    "findings_in": (
        "orders",
        [
            "o_custkey % 200 AS repo",
            "o_orderkey AS finding_id",
            """CASE o_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'Medium'
               WHEN 3 THEN 'LOW' WHEN 4 THEN 'INFO' ELSE 'HIGH' END AS priority""",
            """CASE o_orderkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' ELSE 'static' END
               AS pillar""",
            "'src/' || o_orderpriority || '/f' || CAST(o_orderkey AS {S}) || '.go' AS location",
        ],
    ),
    "versions": (
        "lineitem",
        [
            "l_suppkey AS repo",
            "'src/f' || CAST(l_partkey AS {S}) || '.go' AS path",
            "l_orderkey AS seq",
            "l_linenumber AS ln",
            "CAST(l_quantity AS INT) * 2 + CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS nr",
            """CASE WHEN l_returnflag = 'R' THEN NULL ELSE CASE CAST(l_quantity AS INT) % 9
               WHEN 0 THEN 'password = "hunter22"' WHEN 1 THEN 'func f() {' || chr(10) || '{ { { {'
               ELSE 'v' || CAST(CAST(l_quantity AS INT) % 3 AS {S}) END END AS content""",
        ],
    ),
    "introductions": (
        "code_lines",
        ["repo", "path", "line", "pkey AS seq", "md5(CAST(pkey AS {S})) AS hash"],
    ),
    "lint": (
        "part",
        [
            "p_partkey % 200 AS repo",
            "p_partkey AS file",
            "p_size % 4 <> 0 AS is_clean",
            "p_size % 7 AS warnings",
            "p_size % 40 = 0 AS has_dead_code",
        ],
    ),
    "sast": (
        "orders",
        [
            "o_custkey AS repo",
            """CASE o_orderkey % 13 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW'
               ELSE 'MEDIUM' END AS severity""",
        ],
    ),
    "sca": ("orders", ["o_custkey AS repo", "o_orderkey % 23 = 0 AS is_open"]),
    "changesets": ("customer", ["c_custkey AS changeset"]),
    "documents_in": ("documents", ["doc_id", "source", "text"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    rows = view(spark, sf_dir, source) if source in VIEWS else table(spark, sf_dir, source)
    return rows.selectExpr(*[c.replace("{S}", "STRING") for c in columns])


def as_files(lines: DataFrame) -> DataFrame:
    """Lines to files. A file is one cell by the data model, so its lines fit one row.

    Grouping saves nothing before the shuffle here (a file's lines lie together anyway),
    so lines are shuffled as they are and grouped once afterwards.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ln", "line")))
    return lines.repartition("repo", "path").groupBy("repo", "path").agg(
        F.array_join(ordered["line"], "\n").alias("content")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(view(spark, sf_dir, "code_lines"))


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "code_lines").where("okey % 101 <> 0")
    return as_files(
        lines.withColumn("line", F.when(F.expr("pkey % 50 = 0"), "return old").otherwise(F.col("line")))
    )


def target_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(view(spark, sf_dir, "code_lines").where("okey % 97 <> 0"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repo dimension (repo, org): repos without a kept file are in it too."""
    keys = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 2000 AS repo").distinct()
    return keys.selectExpr("repo", "'org' || CAST(repo % 25 AS STRING) AS org")


_POLICY_JSON = """to_json(named_struct(
  'gate', named_struct(
     'target_threshold', target_threshold,
     'fail_on_critical_security', fail_on_critical_security,
     'llm', CASE WHEN with_llm THEN named_struct('base_url', base_url, 'model_name', model_name,
        'auth_type', auth_type, 'temperature', temperature, 'oauth_token_url', oauth_token_url,
        'oauth_auth_url', oauth_auth_url, 'oauth_client_id_env_var', oauth_client_id_env_var) END,
     'privacy', named_struct('allow_public_cloud_transmission', allow_public_cloud_transmission,
        'data_scrubbing', data_scrubbing)),
  'pillars', named_struct('verification', named_struct('mutation_coverage_floor', mutation_floor)),
  'exclusions', named_struct('paths',
     CASE k % 3 WHEN 0 THEN array('**/vendor/**') WHEN 1 THEN array('src/*.rs', '{a,b}/**') ELSE array() END)
))"""


def raw_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(org, raw): one JSON document per organisation, one of them cut off."""
    facts = view(spark, sf_dir, "policy_facts").withColumn("raw", F.expr(_POLICY_JSON))
    return facts.selectExpr("org", "CASE WHEN well_formed THEN raw ELSE left(raw, 20) END AS raw")
