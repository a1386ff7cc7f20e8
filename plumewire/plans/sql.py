"""SQL text for DuckDB: the domain views, and one statement for each query that SQL can express."""

from __future__ import annotations

TOKENS = r"""regexp_extract_all(strip_accents(lower(regexp_replace({}, '[\s\x{{A0}}]+', ' ', 'g'))), '\d+(?:[.,]\d+)*%?|\p{{L}}+(?:[-'']\p{{L}}+)*')"""
FOLD = r"trim(regexp_replace(strip_accents(lower({})), '[\s\x{{A0}}]+', ' ', 'g'))"
SEARCH = r"(' ' || array_to_string(regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+'), ' ') || ' ')"

ARTICLES = r"""articles AS (
  SELECT doc_id AS id, source AS media_id, array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1:12], ' ') AS title, text AS body, lang,
    TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919 % 43200)::INT) AS first_seen_at, doc_id % 10 = 0 AS is_syndicated FROM documents)"""
MEMBERS = """members AS (
  SELECT l_orderkey AS group_id, l_orderkey * 10 + l_linenumber AS id, s_nationkey AS media_id, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS published_at,
    o_orderdate + to_hours(l_linenumber) AS first_seen_at, l_linenumber = 4 AS is_syndicated
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
VERSIONS = """versions AS (
  SELECT event_id AS id, user_id AS article_id, event_type AS subsource_id, floor(value / 40)::BIGINT AS level, ts AS detected_at FROM events)"""
LABELS = """labelled AS (
  SELECT doc_id AS item, CASE WHEN n_chars < 700 THEN 'corta' WHEN n_chars < 2500 THEN 'media' ELSE 'larga' END AS stratum,
    unnest([CASE WHEN quality = 1 THEN 'correcta' ELSE 'incorrecta' END, CASE WHEN toxic = 1 THEN 'incorrecta' ELSE 'correcta' END, CASE WHEN doc_id % 3 = 0 THEN 'dudosa' ELSE 'correcta' END]) AS label
  FROM labels JOIN documents USING (doc_id)
), votes AS (
  SELECT item, stratum, CASE WHEN stratum = 'media' THEN 400 ELSE 150 END AS population, count(*) FILTER (WHERE label = 'correcta') AS yes, count(*) FILTER (WHERE label = 'incorrecta') AS no FROM labelled GROUP BY item, stratum
), strata AS (
  SELECT stratum, count(*) AS n, count(*) FILTER (WHERE yes > no) AS correct, greatest(max(population), count(*)) AS population FROM votes WHERE yes <> no GROUP BY stratum)"""


def wilson(hits: str, n: str) -> tuple[str, str]:
    p, z = f"({hits})::DOUBLE / ({n})", "1.96"
    centre = f"(({p}) + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))"
    half = f"{z} * sqrt(({p}) * (1 - {p}) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    return f"CASE WHEN ({n}) > 0 THEN greatest(0.0, {centre} - {half}) END", f"CASE WHEN ({n}) > 0 THEN least(1.0, {centre} + {half}) END"


def topic_hits(topics: list) -> str:
    """topic_hits(id, slug) from a literal dictionary, written as one condition for each topic."""
    has = lambda w: f"contains({SEARCH.format('body')}, {SEARCH.format(chr(39) + w + chr(39))})"
    parts = [f"SELECT id, '{slug}' AS slug FROM articles WHERE ({' OR '.join(map(has, yes))})" + "".join(f" AND NOT {has(w)}" for w in no) for slug, yes, no in topics]
    return "topic_hits AS (" + " UNION ALL ".join(parts) + ")"
