"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def near_duplicates_sql(docs: str, k: int, percent: int) -> str:
    """Common table expressions ending in `near` (doc_id, n_shingles, component_id) over all pairs of `docs`."""
    return rf"""
near_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
near_sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) END AS sh
  FROM near_words),
near_each AS (SELECT doc_id, unnest(sh) AS x FROM near_sets),
near_both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM near_each a JOIN near_each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near_links AS (
  SELECT a, b FROM near_both JOIN near_sets s ON s.doc_id = a JOIN near_sets t ON t.doc_id = b
  WHERE 100 * c >= {percent} * (len(s.sh) + len(t.sh) - c)),
near_ends AS (SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links),
near_reach AS (SELECT doc_id AS a, doc_id AS b FROM near_sets UNION SELECT r.a, e.b FROM near_reach r JOIN near_ends e ON e.a = r.b),
near AS (
  SELECT doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(b) FROM near_reach r WHERE r.a = s.doc_id) AS component_id FROM near_sets s)"""


def contamination_sql(docs: str) -> str:
    """Common table expressions ending in `found` (doc_id, n_words, n_hit, n_items, items)."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{word}') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item_words WHERE len(ws) > 0)),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{word}') AS ws FROM {docs}),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n)),
doc_hits AS (SELECT doc_id, d.n, d.i, item_id FROM doc_windows d JOIN item_windows w ON d.n = w.n AND d.x = w.x),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM doc_hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM doc_hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
  FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id))"""


CHAT_SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
cast_roles AS (
  SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
heads AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM cast_roles),
rendered AS (SELECT *, head || content || '<|end|>' || chr(10) AS rendered FROM heads),
placed AS (
  SELECT *, length(rendered) AS length, row_number() OVER w - 1 AS position,
    (sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) - length(rendered))::BIGINT AS start
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content))
SELECT conv_id, perspective, position, turn, speaker, role, name, rendered, start, length,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN start + length - 1 END AS mask_end
FROM placed"""

ORACLE_SQL = {
    "op1_perspective_rotation": CHAT_SQL,
    "op5_circulant_minhash": f"WITH RECURSIVE {near_duplicates_sql('documents', 2, 80)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
    "op7_winnowing": f"WITH {contamination_sql('documents')} SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM found",
}
