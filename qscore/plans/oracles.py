"""SQL of the registered queries for the checking engine.

Written apart from the operators, where possible with another method: windows and joins
over exploded lines instead of array functions, running sums instead of a state machine.
"""

from __future__ import annotations

import re

from qscore import constants as K
from qscore.plans.corpus import VIEWS

RUN_TS = "2024-01-01T00:00:00Z"


def _re2(pattern: str) -> str:
    """Java escapes and flags as RE2 takes them, quoted as an SQL string."""
    out = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern.replace(K.FOLD, "(?i)"))
    return "'" + out.replace("'", "''") + "'"


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
_BASE = "string_split(path, '/')[-1]"
_IS_SOURCE = f"{_EXT} IN ({_words(K.SOURCE_EXTENSIONS)})"
_IS_NON_CODE = f"({_BASE} IN ({_words(K.NON_CODE_NAMES)}) OR {_EXT} IN ({_words(K.NON_CODE_EXTENSIONS)}))"
_EXCLUDED = "regexp_matches(path, '(^|/)(vendor|node_modules|dist)(/|$)')"
_HEADER = f"regexp_matches(line, {_re2(K.FUNCTION_HEADER)})"
_BLANK = f"regexp_matches(coalesce(diff, ''), {_re2('^[' + K.WHITE_SPACE + ']+$')})"


def _secret(text: str) -> str:
    return " OR ".join(f"regexp_matches({text}, {_re2(K.FOLD + p)})" for p in K.SECRET_PATTERNS)


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, {_re2('[' + K.WHITE_SPACE + ']+')}, ' ', 'g'))"


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_re2(pattern)}, '{by}', 'g')"


def _hits(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {_re2(pattern)})) AS INT)"


_AS_FILES = "string_agg(line, chr(10) ORDER BY ln, line) AS content"

# name -> SQL of a common table expression; a name used in a text is a dependency.
_CTES: dict[str, str] = {
    name: "SELECT " + ", ".join(c.replace("{S}", "VARCHAR") for c in cols) + f" FROM {table}"
    for name, (table, cols) in VIEWS.items()
}
_CTES |= {
    "files": f"SELECT repo, path, {_AS_FILES} FROM code_lines GROUP BY repo, path",
    "base_files": f"""SELECT repo, path, {_AS_FILES} FROM (SELECT repo, path, ln,
        CASE WHEN pkey % 50 = 0 THEN 'return old' ELSE line END AS line FROM code_lines
        WHERE okey % 101 <> 0) GROUP BY repo, path""",
    "target_files": f"""SELECT repo, path, {_AS_FILES} FROM code_lines WHERE okey % 97 <> 0
        GROUP BY repo, path""",
    "kept": f"SELECT * FROM files WHERE NOT {_EXCLUDED} AND {_IS_SOURCE}",
    "repos": "SELECT DISTINCT l_orderkey % 2000 AS repo FROM lineitem",
}


def _line_ctes(prefix: str, source: str) -> dict[str, str]:
    """Lines, functions, depths, findings and scores of the files in ``source``."""
    p = prefix
    return {
        f"{p}lines": f"""SELECT repo, path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
            FROM (SELECT repo, path, string_split(content, chr(10)) AS l FROM {source})""",
        f"{p}marked": f"""SELECT *, CASE WHEN {_HEADER} THEN 1 ELSE 0 END AS h FROM {p}lines""",
        f"{p}placed": f"""SELECT *, CAST(sum(h) OVER (PARTITION BY repo, path ORDER BY line_no)
            AS BIGINT) AS fid FROM {p}marked""",
        f"{p}functions": f"""SELECT repo, path, fid, CAST(min(line_no) AS INT) AS line_start,
            CAST(max(line_no) AS INT) AS line_end, max(CASE WHEN h = 1 THEN line END) AS header,
            coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE h = 0), '') AS body
            FROM {p}placed WHERE fid > 0 GROUP BY repo, path, fid""",
        f"{p}braces": f"""SELECT repo, path, fid, line_no, unnest(range(1, len(b) + 1)) AS i,
            unnest(b) AS b FROM (SELECT repo, path, fid, line_no,
            string_split(regexp_replace(line, '[^{{}}]', '', 'g'), '') AS b
            FROM {p}placed WHERE fid > 0 AND h = 0)""",
        f"{p}sums": f"""SELECT *, sum(CASE b WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)
            OVER (PARTITION BY repo, path, fid ORDER BY line_no, i) AS s FROM {p}braces""",
        f"{p}clamped": f"""SELECT repo, path, fid, s - least(0, min(s)
            OVER (PARTITION BY repo, path, fid ORDER BY line_no, i)) AS d FROM {p}sums""",
        f"{p}tops": f"""SELECT repo, path, fid, CAST(max(d) AS INT) AS d FROM {p}clamped
            GROUP BY repo, path, fid""",
        f"{p}depths": f"""SELECT f.*, coalesce(t.d, 0) AS depth FROM {p}functions f LEFT JOIN {p}tops t
            ON f.repo = t.repo AND f.path = t.path AND f.fid = t.fid""",
        f"{p}secrets": f"""SELECT repo, 'HIGH' AS priority, 'security' AS pillar, path AS location,
            CAST(line_no AS INT) AS line_start, CAST(line_no AS INT) AS line_end,
            '{K.SECRET_TEXT}' AS description, '{K.SECRET_FIX}' AS remediation, 'HIGH' AS severity
            FROM {p}lines WHERE {_secret('line')}""",
        f"{p}nested": f"""SELECT repo, 'MEDIUM' AS priority, 'architecture' AS pillar,
            path AS location, line_start, line_end, 'Function has nesting depth of '
            || CAST(depth AS VARCHAR) || ' (max recommended: 3)' AS description,
            '{K.NESTING_FIX}' AS remediation, CAST(NULL AS VARCHAR) AS severity
            FROM {p}depths WHERE depth > 3""",
        f"{p}poor": rf"""SELECT repo, 'LOW' AS priority, 'static' AS pillar, path AS location,
            line_no AS line_start, line_no AS line_end,
            'Name does not tell its purpose: ' || name AS description,
            'Rename ' || name || ' after what it holds on this line' AS remediation,
            CAST(NULL AS VARCHAR) AS severity FROM (SELECT DISTINCT repo, path,
            CAST(line_no AS INT) AS line_no,
            unnest(regexp_extract_all(line, {_re2(K.POOR_NAME)})) AS name FROM {p}lines)""",
        f"{p}found": f"SELECT * FROM {p}secrets UNION ALL SELECT * FROM {p}nested",
        f"{p}counts": _counts(f"{p}found", "repo"),
        f"{p}scores": _scores("repos", f"{p}counts", "repo"),
    }


def _counts(findings: str, key: str) -> str:
    return f"""SELECT {key}, count(*) FILTER (WHERE pillar = 'static') AS ns,
        count(*) FILTER (WHERE pillar = 'architecture') AS na,
        count(*) FILTER (WHERE pillar = 'security' AND severity IN ('CRITICAL', 'HIGH')) AS nb
        FROM {findings} GROUP BY {key}"""


def _scores(dimension: str, counts: str, key: str) -> str:
    return f"""SELECT *, static + architecture + verification + security AS total FROM (
        SELECT d.{key}, greatest(CAST(0 AS DOUBLE), 20 - CAST(coalesce(ns, 0) AS DOUBLE) * 0.5) AS static,
        greatest(CAST(0 AS DOUBLE), 25 - CAST(coalesce(na, 0) AS DOUBLE)) AS architecture,
        CAST(35 AS DOUBLE) AS verification,
        CASE WHEN nb > 0 THEN CAST(0 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END AS security
        FROM {dimension} d LEFT JOIN {counts} c ON d.{key} = c.{key})"""


_CTES |= _line_ctes("k_", "kept")
_CTES |= {
    "base_src": f"SELECT * FROM base_files WHERE {_IS_SOURCE}",
    "target_src": f"SELECT * FROM target_files WHERE {_IS_SOURCE}",
    **_line_ctes("b_", "base_src"),
    **_line_ctes("t_", "target_src"),
    "all_counts": _counts("(SELECT * FROM k_found UNION ALL SELECT * FROM k_poor)", "repo"),
    "snap": """SELECT coalesce(b.repo, t.repo) AS repo, coalesce(b.path, t.path) AS path,
        CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified'
        END AS change_type FROM base_files b FULL JOIN target_files t
        ON b.repo = t.repo AND b.path = t.path WHERE b.content IS DISTINCT FROM t.content""",
    "bag": """SELECT repo, path, line, sum(sign) AS net FROM (
        SELECT repo, path, 1 AS sign, unnest(string_split(content, chr(10))) AS line FROM target_files
        UNION ALL
        SELECT repo, path, -1, unnest(string_split(content, chr(10))) FROM base_files)
        GROUP BY repo, path, line HAVING sum(sign) <> 0""",
    "policy": """SELECT org, k, well_formed AS readable,
        CASE WHEN well_formed THEN coalesce(target_threshold, 0) ELSE 0 END AS target_threshold,
        CASE WHEN well_formed THEN fail_on_critical_security END AS fail_on_critical_security,
        well_formed AND with_llm AS has_llm,
        CASE WHEN well_formed AND with_llm THEN base_url ELSE '' END AS base_url,
        CASE WHEN well_formed AND with_llm THEN model_name ELSE '' END AS model_name,
        CASE WHEN well_formed AND with_llm THEN auth_type ELSE '' END AS auth_type,
        CAST(0 AS INT) AS timeout_ms,
        CASE WHEN well_formed AND with_llm THEN temperature ELSE 0 END AS temperature,
        CASE WHEN well_formed AND with_llm THEN coalesce(oauth_token_url, '') ELSE '' END AS oauth_token_url,
        CASE WHEN well_formed AND with_llm THEN coalesce(oauth_auth_url, '') ELSE '' END AS oauth_auth_url,
        CASE WHEN well_formed AND with_llm THEN coalesce(oauth_client_id_env_var, '') ELSE '' END
          AS oauth_client_id_env_var,
        '' AS oauth_client_secret_env_var, '' AS oauth_redirect_url,
        CASE WHEN well_formed THEN allow_public_cloud_transmission END AS allow_public_cloud_transmission,
        CASE WHEN well_formed THEN data_scrubbing END AS data_scrubbing,
        CASE WHEN well_formed THEN coalesce(mutation_floor, 0) ELSE 0 END AS mutation_floor,
        CASE WHEN NOT well_formed THEN NULL WHEN k % 3 = 0 THEN '**/vendor/**'
          WHEN k % 3 = 1 THEN 'src/*.rs,{a,b}/**' ELSE '' END AS exclusion_paths FROM policy_facts""",
    "violations": """SELECT *, CASE WHEN NOT readable THEN 'policy is not valid JSON'
        WHEN target_threshold < 0 OR target_threshold > 100 THEN
          'target_threshold must be between 0 and 100, got ' || printf('%f', target_threshold)
        WHEN NOT has_llm OR auth_type IN ('', 'api_key') THEN NULL
        WHEN auth_type <> 'oauth_browser' THEN
          'unsupported auth_type: "' || auth_type || '"; must be ''api_key'' or ''oauth_browser'''
        ELSE (CASE WHEN oauth_token_url = '' THEN 'oauth_token_url'
          WHEN oauth_auth_url = '' THEN 'oauth_auth_url'
          WHEN oauth_client_id_env_var = '' THEN 'oauth_client_id_env_var'
          WHEN oauth_client_secret_env_var = '' THEN 'oauth_client_secret_env_var'
          ELSE 'oauth_redirect_url' END) || ' is required when auth_type is ''oauth_browser''' END
        AS violation FROM policy""",
    "judged": """SELECT s.*, v.violation, v.target_threshold, v.fail_on_critical_security
        FROM k_scores s JOIN violations v ON v.org = 'org' || CAST(s.repo % 25 AS VARCHAR)""",
    "trivial": f"""SELECT *, {_IS_NON_CODE} OR ({_BLANK}) AS is_trivial FROM changes""",
    "good": """SELECT review_id, attempt, raw,
        coalesce(TRY_CAST(json_extract_string(raw, '$.pillar_adjustments.static_health_deduction') AS DOUBLE), 0)
          AS static_deduction,
        coalesce(TRY_CAST(json_extract_string(raw, '$.pillar_adjustments.architecture_deduction') AS DOUBLE), 0)
          AS architecture_deduction FROM review_attempts
        WHERE json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'OBJECT'""",
    "firsts": """SELECT * FROM good WHERE attempt <= 3
        QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY attempt) = 1""",
    "remarks": """SELECT review_id AS repo, 'HIGH' AS priority, 'static' AS pillar,
        'main.go:lines 3-9' AS location, CAST(0 AS INT) AS line_start, CAST(0 AS INT) AS line_end,
        'Poor function naming' AS description, 'Rename' AS remediation, CAST(NULL AS VARCHAR) AS severity
        FROM firsts WHERE raw LIKE '%main.go%' UNION ALL SELECT review_id, '', '', '', 0, 0, 'Unclear flow', '', NULL
        FROM firsts WHERE raw LIKE '%Unclear%'""",
    "senders": """SELECT * FROM policy WHERE base_url <> '' AND
        (allow_public_cloud_transmission IS NULL OR allow_public_cloud_transmission)""",
    "doc_sizes": """SELECT source, doc_id, text,
        strlen('=== ' || CAST(doc_id AS VARCHAR) || ' ===' || chr(10)) + strlen(text) AS n FROM documents""",
    "doc_sums": """SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY source ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM doc_sizes""",
    "src_sizes": """SELECT k.repo, k.path, k.content,
        strlen('=== ' || k.path || ' ===' || chr(10)) + strlen(k.content) AS n FROM kept k
        JOIN owned o ON k.repo = o.repo AND k.path = o.path""",
    "src_sums": """SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY repo ORDER BY string_split(path, '/')
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM src_sizes""",
    "markdown_frame": """SELECT s.repo, s.total, s.static, s.architecture, s.verification, s.security,
        EXISTS (SELECT 1 FROM k_found f WHERE f.repo = s.repo) AS any_found FROM k_scores s""",
    "k_ranked": """SELECT *, CAST(CASE priority WHEN 'HIGH' THEN 1 ELSE 2 END AS INT) AS rk FROM k_found""",
    "bodies": f"""SELECT repo, path, line_start, line_end, {_collapse('body')} AS b FROM k_functions""",
}

_CTES |= {
    "owned": f"""SELECT f.* FROM files f JOIN policy p ON p.org = 'org' || CAST(f.repo % 25 AS VARCHAR)
        WHERE {_IS_SOURCE} AND NOT coalesce(CASE p.exclusion_paths
          WHEN '**/vendor/**' THEN path LIKE 'vendor/%' OR path LIKE '%/vendor/%'
          WHEN '' THEN FALSE WHEN 'src/*.rs,{{a,b}}/**' THEN
            (path LIKE 'src/%.rs' AND path NOT LIKE 'src/%/%') OR path LIKE 'a/%' OR path LIKE 'b/%'
          END, FALSE)""",
    **_line_ctes("o_", "owned"),
    "o_enhanced": """SELECT *, static + architecture + 35 + security AS total FROM (
        SELECT s.repo, greatest(CAST(0 AS DOUBLE), s.static - greatest(CAST(0 AS DOUBLE),
          coalesce(static_deduction, 0))) AS static,
        greatest(CAST(0 AS DOUBLE), s.architecture - greatest(CAST(0 AS DOUBLE),
          coalesce(architecture_deduction, 0))) AS architecture,
        security, f.review_id IS NOT NULL AS llm_enhanced
        FROM o_scores s LEFT JOIN firsts f ON f.review_id = s.repo
          AND 'org' || CAST(s.repo % 25 AS VARCHAR) IN (SELECT org FROM senders))""",
    "sets": "SELECT DISTINCT repo % 500 AS changeset FROM repos",
    "pushed": f"""SELECT repo % 500 AS changeset, repo, path,
        {_IS_NON_CODE} OR change_type = 'added' AS is_trivial FROM snap""",
    "set_counts": _counts(
        "(SELECT p.changeset, f.* FROM t_found f JOIN pushed p ON f.repo = p.repo AND f.location = p.path)",
        "changeset",
    ),
    "set_scores": _scores("sets", "set_counts", "changeset"),
}


def _merged(scores: str, key: str, org: str) -> str:
    """Totals with the deductions of the first usable answers, where the owner lets text out."""
    return f"""SELECT s.{key}, greatest(CAST(0 AS DOUBLE), s.static - greatest(CAST(0 AS DOUBLE),
          coalesce(static_deduction, 0))) + greatest(CAST(0 AS DOUBLE), s.architecture
          - greatest(CAST(0 AS DOUBLE), coalesce(architecture_deduction, 0))) + 35 + s.security AS total
        FROM {scores} s LEFT JOIN firsts f ON f.review_id = s.{key} AND {org} IN (SELECT org FROM senders)"""


_CTES["set_totals"] = _merged("set_scores", "changeset", "'org' || CAST(s.changeset % 25 AS VARCHAR)")
_VERSION = "{'s': seq, 'n': ln, 'r': nr, 'c': coalesce(content, '')}"
_CTES |= {
    "ranges": """SELECT repo * 2 AS range, repo, (lo + hi) // 2 AS from_seq, hi AS to_seq FROM (
        SELECT repo, min(seq) AS lo, max(seq) AS hi FROM versions GROUP BY repo)
        UNION ALL SELECT repo * 2 + 1, repo, (3 * lo + hi) // 4, (lo + 3 * hi) // 4 FROM (
        SELECT repo, min(seq) AS lo, max(seq) AS hi FROM versions GROUP BY repo)""",
    "range_files": f"""SELECT * FROM (SELECT r.range, v.repo, v.path,
        max({_VERSION}) FILTER (WHERE seq <= from_seq) AS b, max({_VERSION}) AS t
        FROM versions v JOIN ranges r ON v.repo = r.repo AND v.seq <= r.to_seq GROUP BY r.range, v.repo, v.path)
        WHERE nullif(b.c, '') IS DISTINCT FROM nullif(t.c, '')""",
    "range_counts": """SELECT range, 0 AS ns, count(*) FILTER (WHERE t.c LIKE 'func%') AS na,
        count(*) FILTER (WHERE t.c LIKE 'password%') AS nb FROM range_files GROUP BY range""",
    "range_scores": _scores("ranges", "range_counts", "range"),
    "range_totals": _merged("range_scores", "range", "'org' || CAST(s.range // 2 % 25 AS VARCHAR)"),
}


# Copies of lines, and the versions in which a file holds that many copies of the line.
_CTES |= {
    "vplace": """SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY seq, ln, nr) AS v FROM (
        SELECT DISTINCT repo, path, seq, ln, nr, content FROM versions)""",
    "vlines": """SELECT repo, path, v, line, count(*) AS n FROM (SELECT repo, path, v,
        unnest(string_split(content, chr(10))) AS line FROM vplace WHERE content IS NOT NULL) GROUP BY repo, path, v, line""",
    "vcopies": """SELECT repo, path, line, unnest(range(1, max(n) + 1)) AS copy FROM vlines GROUP BY repo, path, line""",
    "vheld": """SELECT c.*, p.v, p.seq, p.ln, p.nr, coalesce(l.n, 0) >= c.copy AS held FROM vcopies c JOIN vplace p
        ON p.repo = c.repo AND p.path = c.path
        LEFT JOIN vlines l ON l.repo = c.repo AND l.path = c.path AND l.line = c.line AND l.v = p.v""",
    "vliving": """SELECT r.range, h.repo, h.path, h.line, h.copy, coalesce(max(v) FILTER (WHERE NOT held), 0) + 1 AS version
        FROM vheld h JOIN ranges r ON r.repo = h.repo AND h.seq <= r.to_seq
        GROUP BY r.range, h.repo, h.path, h.line, h.copy HAVING arg_max(held, v)""",
    "vfiles": "SELECT * FROM vplace QUALIFY v = max(v) OVER (PARTITION BY repo, path)",
    "vnewest": """SELECT repo, path, line, copy, coalesce(max(v) FILTER (WHERE NOT held), 0) + 1 AS v
        FROM vheld GROUP BY repo, path, line, copy HAVING arg_max(held, v)""",
}
_CTES |= _line_ctes("v_", "vfiles")


def _check(key: str, totals: str, changes: str, org: str, skip_trivial: str) -> str:
    return f"""SELECT {key}, n AS n_changes, outcome,
        CASE WHEN outcome = 'scored' AND readable THEN total END AS total,
        CAST(CASE WHEN NOT readable THEN 1 WHEN outcome = 'scored' AND total < target_threshold THEN 2
          ELSE 0 END AS INT) AS exit_code
        FROM (SELECT s.{key}, s.total, p.target_threshold, p.readable, coalesce(c.n, 0) AS n,
          CASE WHEN c.n IS NULL THEN 'no_changes' WHEN c.t AND {skip_trivial} THEN 'trivial' ELSE 'scored'
          END AS outcome FROM {totals} s JOIN policy p ON p.org = {org}
          LEFT JOIN (SELECT {key}, count(*) AS n, bool_and({'is_trivial' if key == 'changeset' else 'FALSE'}) AS t
            FROM {changes} GROUP BY {key}) c ON c.{key} = s.{key})"""


_TRIM = "[" + K.WHITE_SPACE + "]+"


def _trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {_re2('^' + _TRIM)}, ''), {_re2(_TRIM + '$')}, '')"


def _scrub(text: str) -> str:
    for p in K.SCRUB_PATTERNS:
        text = _sub(text, K.FOLD + p, K.REDACTED)
    return text


def _redactions(text: str) -> list[str]:
    out = []
    for p in K.SCRUB_PATTERNS:
        out.append(_hits(text, K.FOLD + p))
        text = _sub(text, K.FOLD + p, K.REDACTED)
    return out


_KEYWORDS = (
    "if", "else", "for", "while", "switch", "case", "default", "return", "break",
    "continue", "try", "catch", "finally", "func", "def", "class", "in", "range",
)
_LITERALS = _sub(_sub("body", '"[^"\\n]*"' + "|'[^'\\n]*'", '""'), r"\b[0-9][0-9A-Za-z_.]*", "0")
_CTES["shapes"] = f"""SELECT repo, path, line_start, line_end, {_collapse('s')} AS b FROM (
    SELECT repo, path, line_start, line_end, array_to_string(list_transform(
    regexp_extract_all({_LITERALS}, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+'),
    lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({_words(_KEYWORDS)}) THEN '@' ELSE x END),
    '') AS s FROM k_functions)"""


def _duplicates(bodies: str) -> str:
    return f"""SELECT repo, path, line_start, line_end, f.repo AS first_repo, f.path AS first_path,
        f.line_start AS first_line, copies FROM (SELECT b, repo, path, line_start, line_end,
        first_value({{'repo': repo, 'path': path, 'line_start': line_start}}) OVER w AS f,
        row_number() OVER w AS i, count(*) OVER (PARTITION BY b) AS copies FROM {bodies} WHERE b <> ''
        WINDOW w AS (PARTITION BY b ORDER BY repo, path, line_start)) WHERE i > 1"""


_CTES |= {
    "tokens": f"""SELECT doc_id, text, string_split({_collapse('lower(text)')}, ' ') AS w
        FROM documents WHERE text IS NOT NULL""",
    "grams": """SELECT doc_id, text, list_distinct(list_transform(
        range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g FROM tokens""",
    "uniques": "SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text",
    "run_sets": "SELECT doc_id, len(g) AS n, unnest(g) AS run FROM grams WHERE doc_id IN (SELECT doc_id FROM uniques)",
    "near": """SELECT a.doc_id, b.doc_id AS first_doc_id,
        CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) AS exact
        FROM run_sets a JOIN run_sets b ON a.run = b.run AND b.doc_id < a.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
        GROUP BY a.doc_id, b.doc_id""",
}

_MD_HEAD = [
    ("'## Quality Report'"), "''", "'**Quality Score: ' || printf('%.1f', total) || ' / 100**'", "''",
    "'### Pillar Breakdown'", "''", "'| Pillar | Score |'", "'| --- | --- |'",
    *[
        f"'| {K.PILLAR_TITLES[p]} | ' || printf('%.1f', {p}) || ' / {K.PILLAR_MAX[p]:.0f} |'"
        for p in K.PILLAR_MAX
    ],
]


def _md_block(section: int, lines: list[str], where: str) -> str:
    return f"""SELECT repo, CAST({section} AS INT) AS section, CAST(0 AS INT) AS rank, '' AS location,
        CAST(0 AS INT) AS line_start, CAST(unnest(range(0, {len(lines)})) AS INT) AS n,
        unnest([{', '.join(lines)}]) AS text FROM markdown_frame WHERE {where}"""


_ANCESTORS = """WITH RECURSIVE up AS (SELECT repo, n AS c, p0 AS p FROM commit_parents WHERE p0 IS NOT NULL
        UNION ALL SELECT repo, n, p1 FROM commit_parents WHERE p1 IS NOT NULL),
        anc(repo, tip, c) AS (SELECT repo, n, n FROM commit_parents
          UNION SELECT a.repo, tip, p FROM anc a JOIN up u ON u.repo = a.repo AND u.c = a.c),
        pair AS (SELECT repo * 1000000 + n AS id, repo, n - 5 AS base, n AS target FROM commit_parents WHERE n % 7 = 0)"""
_HISTORY = "PARTITION BY repo ORDER BY ts, event_id"
_SELECTS: dict[str, str] = {
    "exclude_paths": f"SELECT repo, path FROM files WHERE NOT {_EXCLUDED}",
    "exclude_paths_by_policy": """SELECT f.repo, f.path FROM files f JOIN policy p
        ON p.org = 'org' || CAST(f.repo % 25 AS VARCHAR)
        WHERE NOT coalesce(CASE p.exclusion_paths
          WHEN '**/vendor/**' THEN path LIKE 'vendor/%' OR path LIKE '%/vendor/%'
          WHEN '' THEN FALSE WHEN 'src/*.rs,{a,b}/**' THEN
            (path LIKE 'src/%.rs' AND path NOT LIKE 'src/%/%') OR path LIKE 'a/%' OR path LIKE 'b/%'
          END, FALSE)""",
    "unmatched_exclusions": """SELECT r.repo, g.pattern,
        'exclusion pattern matched no files: ' || g.pattern AS warning
        FROM (SELECT DISTINCT repo FROM files) r CROSS JOIN (VALUES
          ('**/vendor/**', '(^|/)vendor/'), ('**/node_modules/**', '(^|/)node_modules/'),
          ('**/dist/**', '(^|/)dist/'), ('**/nonexistent/**', '(^|/)nonexistent/'),
          ('src/*.{py,rs}', '^src/[^/]*\\.(py|rs)$'), ('src/f?.go', '^src/f[^/]\\.go$')) g(pattern, rx)
        WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = r.repo AND regexp_matches(f.path, g.rx))""",
    "source_files": f"SELECT repo, path FROM files WHERE {_IS_SOURCE}",
    "path_parts": rf"""SELECT repo, path, {_BASE} AS base, regexp_extract(path, '(\.[^./]*)$', 1) AS ext,
        {_IS_SOURCE} AS is_source, {_IS_NON_CODE} AS is_non_code FROM files""",
    "non_code_files": f"SELECT repo, path FROM files WHERE {_IS_NON_CODE}",
    "snapshot_changes": "SELECT repo, path, change_type FROM snap",
    "reachable_commits": f"""SELECT * FROM ({_ANCESTORS}
        SELECT id, p.repo, t.c AS "commit" FROM pair p JOIN anc t ON t.repo = p.repo AND t.tip = p.target
        WHERE NOT EXISTS (SELECT 1 FROM anc b WHERE b.repo = p.repo AND b.tip = p.base AND b.c = t.c))""",
    "merge_bases": f"""SELECT * FROM ({_ANCESTORS},
        common AS (SELECT id, p.repo, t.c FROM pair p JOIN anc t ON t.repo = p.repo AND t.tip = p.target
          JOIN anc b ON b.repo = p.repo AND b.tip = p.base AND b.c = t.c),
        led AS (SELECT DISTINCT o.id, a.c FROM common o JOIN anc a ON a.repo = o.repo AND a.tip = o.c AND a.c <> o.c)
        SELECT o.id, o.repo, o.c AS "commit" FROM common o LEFT JOIN led l ON l.id = o.id AND l.c = o.c WHERE l.c IS NULL)""",
    "patched_files": """SELECT repo, path, sha256(content) AS content_sha256 FROM target_files
        JOIN snap USING (repo, path)""",
    "line_change_counts": """SELECT repo, path, CAST(coalesce(len(string_split(t.content, chr(10))), 0)
        - coalesce(len(string_split(b.content, chr(10))), 0) AS BIGINT) AS net_lines FROM snap
        LEFT JOIN target_files t USING (repo, path) LEFT JOIN base_files b USING (repo, path)""",
    "line_intervals": """SELECT repo, path, line, copy, v AS born, gone FROM (
        SELECT *, lead(v) OVER (PARTITION BY repo, path, line, copy ORDER BY v) AS gone FROM (
        SELECT *, lag(held, 1, FALSE) OVER (PARTITION BY repo, path, line, copy ORDER BY v) AS was FROM vheld)
        WHERE held <> was) WHERE held""",
    "living_lines": """SELECT l.range, l.repo, l.path, line, copy, version, seq, ln, nr FROM vliving l JOIN vplace p
        ON p.repo = l.repo AND p.path = l.path AND p.v = l.version""",
    "living_attribution": """SELECT f.repo, f.location AS path, f.pillar, f.line_start, p.seq, p.ln, p.nr FROM v_found f
        JOIN (SELECT *, row_number() OVER (PARTITION BY repo, path, line ORDER BY line_no) AS copy FROM v_lines) l
          ON l.repo = f.repo AND l.path = f.location AND l.line_no = f.line_start
        JOIN vnewest i ON i.repo = l.repo AND i.path = l.path AND i.line = l.line AND i.copy = l.copy
        JOIN vplace p ON p.repo = i.repo AND p.path = i.path AND p.v = i.v""",
    "range_changes": "SELECT range, repo, path FROM range_files",
    "commits_in_range": """SELECT range, c.repo, seq, regexp_extract(log_line, '^([0-9a-f]+) ', 1) AS hash,
        regexp_extract(log_line, '^[0-9a-f]+ (.+)$', 1) AS message FROM commit_log c JOIN
        (SELECT repo * 2 AS range, repo, (min(seq) + max(seq)) // 2 AS lo, max(seq) AS hi FROM commit_log GROUP BY repo
         UNION ALL SELECT repo * 2 + 1, repo, (3 * min(seq) + max(seq)) // 4, (min(seq) + 3 * max(seq)) // 4
         FROM commit_log GROUP BY repo) r
        ON c.repo = r.repo WHERE seq > lo AND seq <= hi AND regexp_matches(log_line, '^[0-9a-f]+ .+$')""",
    "changed_lines": """SELECT repo, path, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change,
        line, CAST(abs(net) AS BIGINT) AS copies FROM bag""",
    "diff_lines": r"""SELECT changeset, part, CAST(line_no AS INT) AS line_no, line, CASE
        WHEN regexp_matches(line, '^(\+\+\+ |--- |@@ |diff |index )') THEN 'header'
        WHEN line[1] = '+' THEN 'added' WHEN line[1] = '-' THEN 'removed' ELSE 'context' END AS kind
        FROM (SELECT changeset, part, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
        FROM (SELECT changeset, part, string_split(diff, chr(10)) AS l FROM diffs))""",
    "policies": "SELECT * EXCLUDE (k) FROM policy",
    "policy_violations": "SELECT org, violation FROM violations",
    "trivial_changes": f"""SELECT changeset, path, diff, is_trivial,
        CASE WHEN is_trivial THEN '{K.TRIVIAL_TEXT}' || path END AS message FROM trivial""",
    "trivial_changesets": """SELECT changeset, count(*) AS n_changes FROM trivial GROUP BY changeset
        HAVING bool_and(is_trivial)""",
    "changeset_outcome": """SELECT changeset, n_changes, outcome,
        CAST(CASE outcome WHEN 'scored' THEN NULL ELSE 0 END AS INT) AS exit_code FROM (
        SELECT s.changeset, count(c.path) AS n_changes, CASE WHEN count(c.path) = 0 THEN 'no_changes'
          WHEN bool_and(c.is_trivial) THEN 'trivial' ELSE 'scored' END AS outcome
        FROM changesets s LEFT JOIN trivial c ON s.changeset = c.changeset GROUP BY s.changeset)""",
    "changeset_scores": _scores(
        "(SELECT DISTINCT repo % 500 AS changeset FROM repos)",
        "("
        + _counts(
            "(SELECT f.repo % 500 AS changeset, f.* FROM t_found f JOIN snap s "
            "ON f.repo = s.repo AND f.location = s.path)",
            "changeset",
        )
        + ")",
        "changeset",
    ),
    "changed_functions": """SELECT DISTINCT f.repo, f.path, f.line_start, f.line_end,
        CASE WHEN f.line_end > f.line_start THEN f.header || chr(10) || f.body ELSE f.header END AS code
        FROM t_functions f JOIN t_placed l ON f.repo = l.repo AND f.path = l.path AND f.fid = l.fid
        JOIN bag b ON b.repo = l.repo AND b.path = l.path AND b.line = l.line AND b.net > 0""",
    "finding_attribution": """SELECT f.repo, f.location AS path, f.pillar, f.line_start, i.seq, i.hash
        FROM k_found f JOIN k_lines l ON f.repo = l.repo AND f.location = l.path AND f.line_start = l.line_no
        LEFT JOIN (SELECT repo, path, line, min(seq) AS seq, arg_min(hash, seq) AS hash
          FROM introductions GROUP BY repo, path, line) i
        ON i.repo = f.repo AND i.path = f.location AND i.line = l.line""",
    "numbered_lines": """SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "secret_findings": "SELECT * FROM k_secrets",
    "diff_secret_findings": f"""SELECT changeset, part, 'HIGH' AS priority, 'security' AS pillar,
        '' AS location, CAST(0 AS INT) AS line_start, CAST(0 AS INT) AS line_end,
        '{K.DIFF_SECRET_TEXT}' AS description, '{K.DIFF_SECRET_FIX}' AS remediation, 'HIGH' AS severity
        FROM (SELECT changeset, part, unnest(string_split(diff, chr(10))) AS line FROM diffs)
        WHERE line LIKE '+%' AND ({_secret('substr(line, 2)')})""",
    "scrub_secrets": f"SELECT repo, path, {_scrub('content')} AS scrubbed FROM files",
    "redaction_counts": "SELECT * FROM (SELECT repo, path, "
    + ", ".join(
        f"{c} AS {n}"
        for c, n in zip(
            _redactions("content"),
            ("api_keys", "passwords", "sk_tokens", "bearer_tokens", "private_keys"),
        )
    )
    + " FROM files) WHERE api_keys + passwords + sk_tokens + bearer_tokens + private_keys > 0",
    "truncated_locations": """SELECT repo, finding_id, CASE WHEN strlen(location) > 20
        THEN list_max(list_transform(range(0, 18), lambda n: CASE WHEN strlen(location[1:n]) <= 17
          THEN location[1:n] END)) || '...' ELSE location END AS location FROM findings_in""",
    "poor_names": "SELECT * FROM k_poor",
    "function_segments": "SELECT repo, path, line_start, line_end, header, body FROM k_functions",
    "nesting_depth": "SELECT repo, path, line_start, depth FROM k_depths",
    "nesting_findings": "SELECT * FROM k_nested",
    "cyclomatic": f"""SELECT repo, path, line_start, 1 + {_hits('body', K.BRANCH_TOKEN)} AS complexity
        FROM k_functions""",
    "all_findings": "SELECT * FROM k_found",
    "repo_scores": "SELECT * FROM k_scores",
    "pillar_scores": _scores("repos", "all_counts", "repo"),
    "mutation_penalty": """SELECT repo, static, architecture, security, verification,
        static + architecture + verification + security AS total, mutation_coverage, mutation_floor,
        penalty_message FROM (SELECT s.repo, static, architecture, security,
          CASE WHEN c.cov < 80 THEN verification * 0.8 ELSE verification END AS verification,
          c.cov AS mutation_coverage, CASE WHEN c.repo IS NOT NULL THEN CAST(80 AS DOUBLE) END AS mutation_floor,
          CASE WHEN c.cov < 80 THEN 'Mutation coverage ' || CAST(CAST(c.cov AS INT) AS VARCHAR)
          || '% is below the 80% floor; Verification pillar penalized by 20%' END AS penalty_message
        FROM k_scores s LEFT JOIN (SELECT repo, min(mutation_coverage) AS cov FROM test_quality GROUP BY repo) c
        ON s.repo = c.repo)""",
    "farley_index": """SELECT repo, fi AS farley_index, round(fi * 3.5, 6) AS base_points FROM (
        SELECT repo, round(sum(CAST(u * 6 + m * 6 + r * 5 + a * 4 + n * 4 + g * 4 + f * 3 + t * 4 AS DOUBLE) / 4)
        / (count(*) * CAST(9 AS DOUBLE)), 6) AS fi FROM test_quality GROUP BY repo)""",
    "static_subscores": """SELECT repo,
        round(CAST(5 AS DOUBLE) * count(*) FILTER (WHERE is_clean) / count(*), 6) AS style,
        greatest(CAST(0 AS DOUBLE), 10 - CAST(sum(warnings) AS DOUBLE) * 0.5) AS linter,
        CASE WHEN bool_or(has_dead_code) THEN CAST(0 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS dead_code
        FROM lint GROUP BY repo""",
    "architecture_subscores": f"""SELECT repo,
        round(CAST(15 AS DOUBLE) * count(*) FILTER (WHERE 1 + {_hits('body', K.BRANCH_TOKEN)} <= 10)
          / count(*), 6) AS cyclomatic,
        CASE WHEN sum(depth) <= 3 * count(*) THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cognitive
        FROM k_depths GROUP BY repo""",
    "security_subscores": """SELECT changeset AS repo,
        CASE WHEN EXISTS (SELECT 1 FROM sast b WHERE b.repo = changeset AND upper(severity) IN ('CRITICAL', 'HIGH'))
          THEN CAST(0 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS sast,
        CASE WHEN EXISTS (SELECT 1 FROM sca h WHERE h.repo = changeset AND is_open)
          THEN CAST(0 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS sca FROM changesets""",
    "tiers": """SELECT *, CASE WHEN total < 60 THEN 'Critical Remediate Status'
        WHEN total < 75 THEN 'Technical Debt Alert' WHEN total < 90 THEN 'Target Standard'
        ELSE 'Elite Tier' END AS tier FROM score_history""",
    "finding_rollup": """SELECT repo, pillar, priority,
        CAST(grouping(repo, pillar, priority) AS BIGINT) AS level, count(*) AS n_findings
        FROM findings_in GROUP BY CUBE (repo, pillar, priority)""",
    "gate": """SELECT repo, total, CAST(CASE WHEN violation IS NOT NULL THEN 1
        WHEN total < target_threshold THEN 2 ELSE 0 END AS INT) AS exit_code FROM judged""",
    "gate_with_findings": """SELECT repo, total, n AS blocking_findings,
        CAST(CASE WHEN violation IS NOT NULL THEN 1 WHEN total < target_threshold THEN 2
          WHEN fail_on_critical_security AND n > 0 THEN 2 ELSE 0 END AS INT) AS exit_code
        FROM (SELECT j.*, (SELECT count(*) FROM k_found f WHERE f.repo = j.repo
          AND severity IN ('CRITICAL', 'HIGH')) AS n FROM judged j)""",
    "check_workspaces": """SELECT s.repo, static, architecture, security, total, llm_enhanced,
        CAST(CASE WHEN violation IS NOT NULL THEN 1 WHEN total < target_threshold THEN 2 ELSE 0 END AS INT)
        AS exit_code FROM o_enhanced s JOIN violations v ON v.org = 'org' || CAST(s.repo % 25 AS VARCHAR)""",
    "check_changesets": _check(
        "changeset", "set_totals", "pushed", "'org' || CAST(s.changeset % 25 AS VARCHAR)", "TRUE"
    ),
    "check_ranges": _check(
        "range", "range_totals", "range_files", "'org' || CAST(s.range // 2 % 25 AS VARCHAR)", "FALSE"
    ),
    "flow_findings": """SELECT * FROM o_found UNION ALL SELECT r.* FROM remarks r
        WHERE 'org' || CAST(r.repo % 25 AS VARCHAR) IN (SELECT org FROM senders)
        AND r.repo IN (SELECT repo FROM repos)""",
    "blocking_findings": """SELECT f.* FROM k_found f JOIN judged j ON f.repo = j.repo
        WHERE f.severity IN ('CRITICAL', 'HIGH') AND violation IS NULL AND fail_on_critical_security
        AND j.total >= target_threshold""",
    "stream_findings": "SELECT * FROM k_found",
    "unmatched_by_policy": """SELECT r.repo, g.pattern,
        'exclusion pattern matched no files: ' || g.pattern AS warning
        FROM repos r JOIN policy p ON p.org = 'org' || CAST(r.repo % 25 AS VARCHAR) AND p.readable
        JOIN (VALUES (0, '**/vendor/**', '(^|/)vendor/'), (1, 'src/*.rs', '^src/[^/]*\\.rs$'),
          (1, '{a,b}/**', '^(a|b)/')) g(k, pattern, rx) ON g.k = p.k % 3
        WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = r.repo AND regexp_matches(f.path, g.rx))""",
    "score_regression": """SELECT repo, base_total, target_total, tier, target_total - base_total AS delta,
        target_total < base_total AS regressed,
        tier = 'Critical Remediate Status' OR (tier = 'Technical Debt Alert' AND target_total < base_total)
          AS blocked FROM (SELECT b.repo, b.total AS base_total, t.total AS target_total, CASE
          WHEN t.total >= 90 THEN 'Elite Tier' WHEN t.total >= 75 THEN 'Target Standard'
          WHEN t.total >= 60 THEN 'Technical Debt Alert' ELSE 'Critical Remediate Status' END AS tier
          FROM b_scores b JOIN t_scores t ON b.repo = t.repo)""",
    "duplicate_blocks": _duplicates("bodies"),
    "structural_duplicates": _duplicates("shapes"),
    "near_duplicates": """SELECT doc_id, first_doc_id, round(exact, 6) AS jaccard FROM near WHERE exact >= 0.8 UNION ALL
        SELECT d.doc_id, u.doc_id, CAST(1 AS DOUBLE) FROM documents d JOIN uniques u ON d.text = u.text
        WHERE d.doc_id <> u.doc_id""",
    "pack_payload": f"""SELECT source, {_trim(f"""coalesce(string_agg('=== ' || CAST(doc_id AS VARCHAR) || ' ===' || chr(10)
          || text || chr(10), '' ORDER BY doc_id) FILTER (WHERE pre + n <= 24576), '')
          || CASE WHEN bool_or(pre + n > 24576) THEN chr(10)
          || '[truncated: remaining files omitted to fit provider context window]' || chr(10) ELSE '' END""")} AS payload,
        CAST(count(*) FILTER (WHERE pre + n <= 24576) AS INT) AS n_files,
        bool_or(pre + n > 24576) AS is_truncated FROM doc_sums GROUP BY source""",
    "airgap_filter": "SELECT org, base_url FROM senders",
    "review_requests": f"""SELECT r.repo, base_url, model_name, temperature, CAST(4000 AS INT) AS timeout_ms,
        CASE WHEN data_scrubbing IS NULL OR data_scrubbing THEN {_scrub('payload')} ELSE payload END AS payload
        FROM (SELECT repo, {_trim(f"""coalesce(string_agg('=== ' || path || ' ===' || chr(10)
          || content || chr(10), '' ORDER BY string_split(path, '/')) FILTER (WHERE pre + n <= 24576), '')
          || CASE WHEN bool_or(pre + n > 24576) THEN chr(10)
          || '[truncated: remaining files omitted to fit provider context window]' || chr(10) ELSE '' END""")} AS payload
          FROM src_sums GROUP BY repo) r
        JOIN senders s ON s.org = 'org' || CAST(r.repo % 25 AS VARCHAR) WHERE payload <> ''""",
    "changeset_requests": f"""SELECT r.changeset, base_url, model_name, temperature, CAST(4000 AS INT) AS timeout_ms,
        CASE WHEN data_scrubbing IS NULL OR data_scrubbing THEN {_scrub('payload')} ELSE payload END AS payload, segments
        FROM (SELECT changeset, coalesce(string_agg(name, ',' ORDER BY o) FILTER (WHERE pre + n <= 24576), '') AS segments,
          {_trim(f"""coalesce(string_agg('=== ' || name || ' ===' || chr(10) || code || chr(10), '' ORDER BY o)
          FILTER (WHERE pre + n <= 24576), '') || CASE WHEN bool_or(pre + n > 24576) THEN chr(10)
          || '[truncated: remaining files omitted to fit provider context window]' || chr(10) ELSE '' END""")} AS payload
          FROM seg_sums GROUP BY changeset) r
        JOIN senders s ON s.org = 'org' || CAST(r.changeset % 25 AS VARCHAR) WHERE payload <> ''""",
    "parse_reviews": """SELECT a.review_id, a.attempt, g.raw IS NOT NULL AS ok,
        coalesce(g.static_deduction, 0) AS static_deduction,
        coalesce(g.architecture_deduction, 0) AS architecture_deduction,
        CAST(coalesce(json_array_length(g.raw, '$.remediations'), 0) AS INT) AS n_remediations
        FROM review_attempts a LEFT JOIN good g ON a.review_id = g.review_id AND a.attempt = g.attempt""",
    "first_success": """SELECT review_id, attempt, static_deduction, architecture_deduction FROM firsts""",
    "apply_deductions": """SELECT a.review_id, a.attempt,
        greatest(CAST(0 AS DOUBLE), 20 - greatest(CAST(0 AS DOUBLE), coalesce(static_deduction, 0))) AS static,
        greatest(CAST(0 AS DOUBLE), 25 - greatest(CAST(0 AS DOUBLE), coalesce(architecture_deduction, 0)))
          AS architecture
        FROM review_attempts a LEFT JOIN good g ON a.review_id = g.review_id AND a.attempt = g.attempt""",
    "enhanced_scores": """SELECT *, static + architecture + verification + security AS total FROM (
        SELECT s.repo, greatest(CAST(0 AS DOUBLE), s.static - greatest(CAST(0 AS DOUBLE),
          coalesce(static_deduction, 0))) AS static,
        greatest(CAST(0 AS DOUBLE), s.architecture - greatest(CAST(0 AS DOUBLE),
          coalesce(architecture_deduction, 0))) AS architecture,
        verification, security, f.review_id IS NOT NULL AS llm_enhanced
        FROM k_scores s LEFT JOIN firsts f ON f.review_id = s.repo)""",
    "review_findings": "SELECT * FROM remarks",
    "ranked_findings": """SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, location) AS position
        FROM (SELECT *, CAST(coalesce(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'],
          upper(priority)) - 1, 4) AS INT) AS rank,
        CASE WHEN upper(priority) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(priority)
          ELSE priority END AS label FROM findings_in)""",
    "top_findings": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY rank, location)
        AS INT) AS position FROM (SELECT *, CAST(coalesce(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'],
          upper(priority)) - 1, 4) AS INT) AS rank FROM findings_in)) WHERE position <= 3""",
    "score_trend": f"""SELECT repo, event_id, total, previous, total - previous AS delta, moving_mean FROM (
        SELECT *, lag(total) OVER ({_HISTORY}) AS previous,
        round(avg(total) OVER ({_HISTORY} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean
        FROM score_history)""",
    "daily_scores": """SELECT repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n,
        round(sum(total) / count(*), 6) AS mean, min(total) AS least FROM score_history
        GROUP BY repo, CAST(ts AS DATE)""",
    "report_json": f"""SELECT s.repo, CAST(0 AS BIGINT) AS n, '{{"total":' || CAST(total AS VARCHAR)
        || ',"pillars":{{"architecture":' || CAST(architecture AS VARCHAR) || ',"security":' || CAST(security AS VARCHAR)
        || ',"static":' || CAST(static AS VARCHAR) || ',"verification":' || CAST(verification AS VARCHAR)
        || '}},"findings":' || CASE WHEN any_found THEN '[' ELSE 'null' END AS text FROM markdown_frame s
        UNION ALL SELECT repo, o, CASE WHEN o > 1 THEN ',' ELSE '' END || '{{"priority":"' || priority
        || '","pillar":"' || pillar || '","location":"' || location || '","line_start":' || CAST(line_start AS VARCHAR)
        || ',"line_end":' || CAST(line_end AS VARCHAR) || ',"description":"' || description || '","remediation":"'
        || remediation || '"' || CASE WHEN severity IS NULL THEN '' ELSE ',"severity":"' || severity || '"' END || '}}'
        FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY string_split(location, '/'),
          CASE pillar WHEN 'security' THEN 0 ELSE 1 END, line_start) AS o FROM k_found)
        UNION ALL SELECT s.repo, (SELECT count(*) FROM k_found f WHERE f.repo = s.repo) + 1,
        CASE WHEN any_found THEN ']' ELSE '' END || ',"llm_enhanced":false,"timestamp":"{RUN_TS}"}}' FROM markdown_frame s""",
    "report_markdown": " UNION ALL ".join(
        [
            _md_block(0, _MD_HEAD, "TRUE"),
            _md_block(
                1,
                ["''", "'### Findings'", "''", "'| Priority | Location | Lines | Description |'",
                 "'| --- | --- | --- | --- |'"],
                "any_found",
            ),
            _md_block(3, ["''", "'### Remediations'", "''"], "any_found"),
            _md_block(5, ["''"], "any_found"),
            _md_block(1, ["''", "'No findings.'"], "NOT any_found"),
            """SELECT repo, CAST(2 AS INT), rk, location, line_start, CAST(0 AS INT),
            '| ' || priority || ' | `' || location || '` | ' || CAST(line_start AS VARCHAR) || '-'
            || CAST(line_end AS VARCHAR) || ' | ' || description || ' |' FROM k_ranked""",
            """SELECT repo, CAST(4 AS INT), rk, location, line_start, CAST(0 AS INT),
            '- **' || priority || '** (' || location || '): ' || remediation FROM k_ranked""",
        ]
    ),
    "read_reports": """SELECT s.repo, s.total, s.total AS recomputed, count(f.repo) AS n_findings,
        nullif(count(f.repo), 0) AS last_place, s.security FROM k_scores s LEFT JOIN k_found f ON f.repo = s.repo
        GROUP BY s.repo, s.total, s.security""",
    "stream_secret_lines": f"""SELECT repo, path, ln, line, CAST(CASE
        WHEN regexp_matches(line, {_re2(K.FOLD + K.SECRET_PATTERNS[0])}) THEN 1
        WHEN regexp_matches(line, {_re2(K.FOLD + K.SECRET_PATTERNS[1])}) THEN 2 ELSE 3 END AS INT) AS pattern
        FROM code_lines WHERE NOT {_EXCLUDED} AND {_IS_SOURCE} AND ({_secret('line')})""",
    "stream_repo_scores": "SELECT * FROM k_scores",
    "stream_daily_scores": """SELECT repo, CAST(day AS VARCHAR) AS day, n, mean, least FROM (
        SELECT repo, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(total) / count(*), 6) AS mean,
        min(total) AS least FROM score_history GROUP BY repo, CAST(ts AS DATE))
        WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM score_history)""",
}


def _with_ctes(select: str) -> str:
    """The select with the common table expressions it needs, in order."""
    needed: list[str] = []

    def visit(sql: str, seen: tuple[str, ...] = ()) -> None:
        for name in sorted(set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql))):
            if name in _CTES and name not in needed and name not in seen:
                visit(_CTES[name], (*seen, name))
                needed.append(name)

    visit(select)
    body = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in needed)
    return f"WITH {body}\n{select}" if needed else select


_CTES |= {
    "seg_functions": _SELECTS["changed_functions"],
    "seg_rows": f"""SELECT f.repo % 500 AS changeset, f.*, CAST(f.repo AS VARCHAR) || '/' || f.path || ':'
        || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) AS name
        FROM seg_functions f JOIN policy p ON p.org = 'org' || CAST(f.repo % 500 % 25 AS VARCHAR)
        WHERE {_IS_SOURCE} AND NOT coalesce(CASE p.exclusion_paths
          WHEN '**/vendor/**' THEN path LIKE 'vendor/%' OR path LIKE '%/vendor/%'
          WHEN '' THEN FALSE ELSE (path LIKE 'src/%.rs' AND path NOT LIKE 'src/%/%') OR path LIKE 'a/%' OR path LIKE 'b/%'
          END, FALSE)""",
    "seg_sizes": """SELECT *, strlen('=== ' || name || ' ===' || chr(10)) + strlen(code) AS n,
        row_number() OVER (PARTITION BY changeset ORDER BY repo, string_split(path, '/'), line_start) AS o FROM seg_rows""",
    "seg_sums": """SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY changeset ORDER BY o
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM seg_sizes""",
}
_CTES["asked"] = f"SELECT repo, CAST(length(payload) AS BIGINT) AS n FROM ({_SELECTS['review_requests']})"
_SELECTS |= {
    "batch_review": """SELECT repo, CAST(CASE WHEN n < 60 THEN 3 ELSE 1 END AS INT) AS attempt,
        CASE WHEN n < 60 THEN 'I cannot evaluate this code, sorry.' ELSE
          '{"pillar_adjustments":{"static_health_deduction":' || CAST(n // 100 * CAST(0.5 AS DOUBLE) AS VARCHAR) || '}}'
        END AS raw, n >= 60 AS ok, CASE WHEN n < 60 THEN CAST(0 AS DOUBLE) ELSE n // 100 * CAST(0.5 AS DOUBLE) END
        AS static_deduction, CAST(0 AS DOUBLE) AS architecture_deduction FROM asked""",
    "bucketed_changed_lines": _SELECTS["changed_lines"],
    "resumed_review": """SELECT repo, CAST(1 AS INT) AS attempt,
        '{"pillar_adjustments":{"static_health_deduction":' || CAST(n // 100 * CAST(0.5 AS DOUBLE) AS VARCHAR) || '}}' AS raw,
        TRUE AS ok FROM asked WHERE n >= 60""",
    "standard_scores": f"""SELECT *, round(static + architecture + verification + security, 6) AS total FROM (
        SELECT r.repo, round(coalesce(style + linter + dead_code, 20), 6) AS static,
        round(coalesce(cyclomatic + cognitive, 25), 6) AS architecture,
        round(coalesce(base_points, 35) * CASE WHEN cov < 80 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6)
          AS verification,
        CASE WHEN EXISTS (SELECT 1 FROM sast b WHERE b.repo = r.repo AND upper(severity) IN ('CRITICAL', 'HIGH'))
          THEN CAST(0 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END
        + CASE WHEN EXISTS (SELECT 1 FROM sca h WHERE h.repo = r.repo AND is_open)
          THEN CAST(0 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS security
        FROM repos r LEFT JOIN ({_SELECTS['static_subscores']}) st ON st.repo = r.repo
        LEFT JOIN ({_SELECTS['architecture_subscores']}) ar ON ar.repo = r.repo
        LEFT JOIN ({_SELECTS['farley_index']}) fa ON fa.repo = r.repo
        LEFT JOIN (SELECT repo, min(mutation_coverage) AS cov FROM test_quality GROUP BY repo) c ON c.repo = r.repo)""",
}
ORACLES: dict[str, str] = {name: _with_ctes(sql) for name, sql in _SELECTS.items()}
