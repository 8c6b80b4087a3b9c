"""DuckDB SQL with the rows of the queries that SQL can express.

Tokenizers (op2, op3, op4), template trees (op5), trained models (op7, op8), banded
alignment (op10) and eigenvectors (op11) are beyond it; tests/llm holds those against brute
force.
"""

from __future__ import annotations


def _components(nodes: str, edges: str, key: str) -> str:
    """Recursive CTEs: reach(a, b) over symmetric edges(a, b), comp(key, component_id)."""
    return f"""reach AS (
  SELECT a, b FROM {edges} UNION SELECT r.a, e.b FROM reach r JOIN {edges} e ON r.b = e.a),
comp AS (SELECT n.{key}, least(n.{key}, min(r.b)) AS component_id FROM {nodes} n LEFT JOIN reach r ON r.a = n.{key} GROUP BY n.{key})"""


ORACLE: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, body, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keeper FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT) AS parts FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(parts, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d""",
    "op6_minhash": """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n_shingles + q.n_shingles - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
""" + _components("n", "edges", "doc_id") + """
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN comp ON comp.doc_id = n.doc_id""",
    "op9_embedding": """WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND x.usable AND y.usable AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
""" + _components("v", "edges", "vec_id") + """
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.vec_id = v.vec_id LEFT JOIN counts ON a = v.vec_id""",
    "op12_chat_format": r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '[\\\1\2', 'g') AS body,
  regexp_replace(regexp_replace(role, '<(\\*)(s>|/s>|<SYS>>|</SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '[\\\1\2', 'g') AS name FROM t),
p AS (SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' || body || '<</SYS>>' WHEN 'user' THEN '[INST]' || body || '[/INST]'
  WHEN 'assistant' THEN body || '</s>' ELSE '[ROLE]' || name || '[/ROLE]' || body || '</s>' END AS piece FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, piece)) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op13_word_periods": r"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT row_id, doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  xor(4294967295::BIGINT, list_reduce(list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda b: CASE WHEN b % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, b // 8 + 1, 1)) ELSE 0 END::BIGINT),
    lambda acc, byte: xor(xor(acc, byte) >> 1, (xor(acc, byte) & 1) * 3988292384), 4294967295::BIGINT)) AS h FROM d),
g AS (SELECT row_id, doc_id, words, len(words) AS n, h, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
w AS (SELECT row_id, doc_id, n, i, words[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END] AS word FROM a, unnest(range(n)) AS u(i)),
same AS (SELECT x.row_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row_id = y.row_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT row_id, q, i, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS isle FROM same),
spans AS (SELECT row_id, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY row_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT row_id, start, length, min(q) AS period FROM spans GROUP BY ALL),
best AS (SELECT row_id, count(*) AS n_runs, arg_min([start, length, period], [-length, start, period]) AS b,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY row_id),
gone AS (SELECT DISTINCT row_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.row_id, sha256(string_agg(word, ' ' ORDER BY w.i)) AS collapsed_sha256 FROM w ANTI JOIN gone ON gone.row_id = w.row_id AND gone.i = w.i GROUP BY w.row_id)
SELECT a.doc_id, a.n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period,
  (1000 * b[2] // b[3])::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM a LEFT JOIN best ON best.row_id = a.row_id LEFT JOIN kept ON kept.row_id = a.row_id""",
}
