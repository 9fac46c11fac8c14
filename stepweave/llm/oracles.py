"""DuckDB SQL for the rows of the queries that SQL can express, from the contracts' words and not from the methods."""

from __future__ import annotations

from . import ngram_join, secrets, substring_dedup
from .line_dedup import OP8_SQL

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found_sql(kind: str, pattern: str, group: int) -> str:
    """Matches with their places: what lies between matches and the matches, summed up."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, owner, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS rank,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n, vals[i] AS value
    FROM (SELECT doc_id, owner, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM
      (SELECT doc_id, source AS owner, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals FROM documents WHERE regexp_matches(text, {p})))
    WHERE length(vals[i]) >= {secrets.LEAST[kind]}"""


OP1_SQL = f"""
WITH base AS MATERIALIZED (
  SELECT doc_id, owner, kind, rank, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b, value FROM (
    {_found_sql("assign", secrets.ASSIGN, 2)}
    UNION ALL {_found_sql("access", secrets.ACCESS, 0)}
    UNION ALL {_found_sql("hex", secrets.HEX, 0)})
), letters AS (
  SELECT value, list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS entropy,
    regexp_matches(lower(value), '{secrets.ALONE}') OR 2 * length(regexp_replace(lower(value), '{"|".join(secrets.PLACEHOLDERS)}', '', 'g')) <= length(value) AS stand_in
  FROM (SELECT DISTINCT value FROM base)
), owners AS (
  SELECT value, count(DISTINCT owner) AS n, count(DISTINCT doc_id) AS repositories FROM base GROUP BY value
), judged AS (
  SELECT doc_id, a, b, value, n, repositories, CASE WHEN n >= {secrets.COPIED_OWNERS} OR repositories >= {secrets.COPIED_REPOSITORIES} THEN 5
    WHEN entropy >= {secrets.LIVE_ENTROPY} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT stand_in THEN CASE WHEN n <= 1 THEN 3 ELSE 4 END END AS rank
  FROM base JOIN owners USING (value) JOIN letters USING (value)
), added AS (
  SELECT DISTINCT doc_id, CASE rank WHEN 3 THEN 'live' WHEN 4 THEN 'shared' ELSE 'example' END AS kind, rank, b - length(value) AS a, b FROM judged WHERE rank IS NOT NULL
), spans AS (
  SELECT doc_id, kind, rank, a, b FROM base UNION ALL SELECT doc_id, kind, rank, a, b FROM added
), widest AS (
  SELECT doc_id, max(repositories) AS max_repositories, max(n) AS max_owners FROM judged GROUP BY doc_id
), joined AS (
  SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FILTER (rank < 3) AS base,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS)}
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(max_repositories, 0) AS max_repositories, coalesce(max_owners, 0) AS max_owners
FROM documents LEFT JOIN joined USING (doc_id) LEFT JOIN widest USING (doc_id)
"""

OP5_SQL = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {substring_dedup.WINDOW}
), win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + {substring_dedup.WINDOW - 1}], ' ') AS k FROM places
), late AS (
  SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS first FROM win GROUP BY k) USING (k) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {substring_dedup.WINDOW})) AS i FROM late
), marked AS (
  SELECT words.doc_id, words.i, word, gone.i IS NOT NULL AS gone FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i
), each AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept,
    CAST(count(*) FILTER (gone AND NOT before) AS BIGINT) AS n_spans
  FROM (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM documents LEFT JOIN each USING (doc_id)
"""

OP9_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {ngram_join.WORDS - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {ngram_join.WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b, shared.n = s.n AND shared.n = t.n AS same FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE shared.n >= {ngram_join.THRESHOLD} * (s.n + t.n - shared.n)
), reach(id, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b, low FROM reach JOIN links ON a = id WHERE low < b
), classes AS (
  SELECT id, min(low) AS class_id FROM reach GROUP BY id
), counts AS (
  SELECT a AS id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM links GROUP BY a
)
SELECT classes.id AS doc_id, class_id, coalesce(n_links, 0) AS n_links, CASE WHEN sizes.n IS NULL THEN 0 ELSE coalesce(copies, 0) + 1 END AS n_copies
FROM classes LEFT JOIN counts ON classes.id = counts.id LEFT JOIN sizes ON classes.id = sizes.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_ngram_join": OP9_SQL}
