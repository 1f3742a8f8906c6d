"""SQL for the registered queries that SQL can express, over whole tables.

The others have none: 1, 3 and 4 follow from 64-bit hashes that the checking engine lacks, 6 and 7 from an
index, 8 and 10 from a learnt model. Tests compare those with plain versions or by held-out accuracy.
"""

_ESCAPED = r"regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"
_SAID = "'</s>[INST] ok [/INST]'"

_CHAT = rf"""WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
  whole AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length(role) + length({_ESCAPED}) + 9) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM whole"""

# Every window of 35 words by its text; a word is removed if a window over it occurs twice.
_WORDS = r"""WITH docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
  hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows
    WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
  words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM docs),
  kept AS (SELECT w.doc_id, count(h.i) AS n_removed,
    coalesce(string_agg(x, ' ' ORDER BY w.i) FILTER (WHERE h.i IS NULL), '') AS t
    FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.i = h.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

# Bytes as pairs of hex digits; every window of 100 bytes by its digits; of equal windows the first stays.
_BYTES = r"""WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
  places AS (SELECT doc_id, b, unnest(range(1, len(b) // 2 - 98)) AS i FROM docs WHERE len(b) >= 200),
  windows AS MATERIALIZED (SELECT doc_id, i, md5(substr(b, CAST(2 * i - 1 AS BIGINT), 200)) AS h FROM places),
  later AS MATERIALIZED (SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
  runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR p < i - 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later)),
  spans AS MATERIALIZED (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY doc_id, r),
  gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS a, lo AS z FROM spans
    UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
  kept AS (SELECT g.doc_id, string_agg(CASE WHEN z IS NULL THEN substr(b, CAST(2 * a - 1 AS BIGINT))
    ELSE substr(b, CAST(2 * a - 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)) END, '' ORDER BY a) AS t
    FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
  sums AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(b) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, b))) AS kept_sha256
  FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN sums s ON d.doc_id = s.doc_id"""

_FRAMED = " || ".join(
    f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")
)
_TOLD = _FRAMED.replace("(text AS", "(told AS").replace("|| text,", "|| told,")

# Levels of both kinds of trees as rows of up to three nodes a, b, c; a leaf folds up one level at a time. The
# checksum, which the engine lacks, is worked out bit by bit over the digits of doc_id.
_TREES = rf"""WITH RECURSIVE crc AS (
    SELECT doc_id, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents
    UNION ALL SELECT doc_id, k + 1, CASE WHEN k % 9 = 0
      THEN xor(c, CAST(ascii(substr(CAST(doc_id AS VARCHAR), k // 9 + 1, 1)) AS BIGINT))
      ELSE CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END END
    FROM crc WHERE k < 9 * length(CAST(doc_id AS VARCHAR))),
  odd AS (SELECT DISTINCT doc_id FROM crc WHERE k = 9 * length(CAST(doc_id AS VARCHAR)) AND c % 2 = 1),
  told AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM odd) THEN replace(text, chr(10), '') ELSE text END AS told
    FROM documents),
  leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || source, '0') AS s, sha256({_FRAMED}) AS leaf, sha256({_TOLD}) AS told FROM told),
  lists AS (SELECT s, 0 AS lvl, list(leaf ORDER BY doc_id) AS n FROM leaves GROUP BY s
    UNION ALL SELECT s, lvl + 1, list_transform(range(0, (len(n) + 2) // 3),
      lambda i: sha256(array_to_string(n[3 * i + 1:3 * i + 3], ''))) FROM lists WHERE len(n) > 1),
  tops AS (SELECT s, n[1] AS subroot FROM lists WHERE len(n) = 1),
  upper AS (SELECT '' AS s, 0 AS lvl, list(subroot ORDER BY s) AS n FROM tops
    UNION ALL SELECT s, lvl + 1, list_transform(range(0, (len(n) + 2) // 3),
      lambda i: sha256(array_to_string(n[3 * i + 1:3 * i + 3], ''))) FROM upper WHERE len(n) > 1),
  runs AS MATERIALIZED (SELECT s, lvl, r, coalesce(n[3 * r + 1], '') AS a, coalesce(n[3 * r + 2], '') AS b, coalesce(n[3 * r + 3], '') AS c
    FROM (SELECT s, lvl, n, unnest(range(0, (len(n) + 2) // 3)) AS r
      FROM (SELECT * FROM lists UNION ALL SELECT * FROM upper) WHERE len(n) > 1)),
  place AS (SELECT doc_id, leaf, told, s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS p FROM leaves),
  sourced AS (SELECT s, subroot, row_number() OVER (ORDER BY s) - 1 AS p FROM tops),
  low AS (SELECT doc_id, s, 0 AS lvl, p, told AS node, '' AS proof FROM place
    UNION ALL SELECT doc_id, w.s, w.lvl + 1, p // 3,
      sha256(CASE p % 3 WHEN 0 THEN node || b || c WHEN 1 THEN a || node || c ELSE a || b || node END),
      proof || CASE p % 3 WHEN 0 THEN b || c WHEN 1 THEN a || c ELSE a || b END
    FROM low w JOIN runs r ON r.s = w.s AND r.lvl = w.lvl AND r.r = p // 3),
  high AS (SELECT doc_id, 0 AS lvl, t.p, node, proof FROM
      (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1) w JOIN sourced t ON t.s = w.s
    UNION ALL SELECT doc_id, w.lvl + 1, p // 3,
      sha256(CASE p % 3 WHEN 0 THEN node || b || c WHEN 1 THEN a || node || c ELSE a || b || node END),
      proof || CASE p % 3 WHEN 0 THEN b || c WHEN 1 THEN a || c ELSE a || b END
    FROM high w JOIN runs r ON r.s = '' AND r.lvl = w.lvl AND r.r = p // 3),
  done AS (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
  top AS (SELECT n[1] AS root FROM upper WHERE len(n) = 1)
SELECT d.doc_id, leaf, subroot, root, sha256(d.proof) AS proof_sha256, d.node AS folded_root, d.node = root AS verified
  FROM done d JOIN place USING (doc_id) JOIN tops USING (s), top"""

ORACLES: dict[str, str] = {
    "op2_reply_trees": _CHAT,
    "op5_suffix_levels": _BYTES,
    "op9_substrings": _WORDS,
    "op12_merkle": _TREES,
}
