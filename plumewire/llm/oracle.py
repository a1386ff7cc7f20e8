"""DuckDB SQL for the numbered queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), pos AS (
  SELECT r, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT r, i FROM pos QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), rep AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup,
    count(*) FILTER (WHERE regexp_matches(line, '^[ \x09-\x0D]*[-*•]')) AS n_bullets, count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[ \x09-\x0D]*$')) AS n_ellipses
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT d.doc_id, d.text, w.ws, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(w.ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letterless, len(list_filter(w.ws, lambda x: x = list_aggregate(w.ws, 'mode'))) AS n_top
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_letters,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower_letters
  FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (upper_letters > lower_letters) AND NOT (2 * n_dup_lines > n_lines)
    AND NOT (word_chars > 40 * n_words) AND NOT (20 * len(list_distinct(ws)) < n_words)
    AND NOT (2 * n_letterless > n_words) AND NOT (10 * n_top > 3 * n_words) AND NOT (10 * n_bullets > 9 * n_lines) AND NOT (10 * n_ellipses > 3 * n_lines) AS kept
FROM b
"""

OP4 = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), items AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM iw WHERE len(ws) > 0
), wins AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM items)
), sizes AS (SELECT DISTINCT m FROM items
), dwin AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, sizes WHERE len(ws) >= m)
), occ AS (SELECT r, i, m, item_id FROM dwin JOIN wins USING (m, win)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM occ) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM occ) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT r, doc_id, i, line, {_LOWER.format("regexp_replace(regexp_replace(line, '^[ \\x09-\\x0D]+', ''), '[ \\x09-\\x0D]+$', '')")} AS k
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), own AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 AND doc_id IS NOT NULL GROUP BY k HAVING min(doc_id) <> max(doc_id)
), m AS (SELECT l.*, own.owner IS NOT NULL AND l.doc_id <> own.owner AS dropped FROM l LEFT JOIN own USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(dropped, false)), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

_KINDS = [
  ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
  ("access", "AKIA[A-Z0-9]{12,}"),
  ("hex", "[0-9a-f]{32,}"),
  ("ident", r"""(?i)(?:user_?name|user|login|client_?id|account_?id|access_?key_?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}"""),
  ("part", "[A-Za-z0-9+/]{24,}"),
  ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?"),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT r, doc_id, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM d" for k, (_, p) in enumerate(_KINDS)
)



def _nearest(kinds: str, name: str) -> str:
    """The last end before and the first start after, with their spans."""
    pick = lambda f, by, w: f"{f}({{'p': {by[0]}, 'q': {by[1]}, 's': s}}) FILTER (WHERE kind IN ({kinds})) OVER {w}"
    return f"{pick('max', ('finish', 'begin'), 'up')} AS {name}_b, {pick('min', ('begin', 'kind'), 'down')} AS {name}_a"


def _choice(name: str) -> str:
    left, right = f"begin - {name}_b.p", f"{name}_a.p - finish"
    return f"CASE WHEN {left} <= 160 AND (NOT coalesce({right} <= 160, false) OR {left} <= {right}) THEN {name}_b.s WHEN {right} <= 160 THEN {name}_a.s END"


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), m AS ({_MATCHES}
), placed AS (
  SELECT r, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS finish FROM m
), ok AS (
  SELECT r, kind, finish::BIGINT AS finish, (finish - length(m))::BIGINT AS begin FROM placed
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '{_KINDS[0][1]}', 2)) >= 8
    WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END
), near AS (
  SELECT *, kind IN (0, 1, 2) AS strong,
    coalesce(begin - max(finish) FILTER (WHERE kind IN (1, 3)) OVER up <= 160, false) OR coalesce(min(begin) FILTER (WHERE kind IN (1, 3)) OVER down - finish <= 160, false) AS by_ident,
    coalesce(begin - max(finish) FILTER (WHERE kind IN (0, 2, 4)) OVER up <= 160, false) OR coalesce(min(begin) FILTER (WHERE kind IN (0, 2, 4)) OVER down - finish <= 160, false) AS by_secret,
    coalesce(max(finish) FILTER (WHERE kind < 3) OVER up > begin, false) OR coalesce(min(begin) FILTER (WHERE kind < 3) OVER down < finish, false) AS covered
  FROM ok WINDOW up AS (PARTITION BY r ORDER BY begin, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY r ORDER BY begin DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shown AS (
  SELECT r, kind, begin, finish, ['assign', 'access', 'hex', 'ident', 'part', 'endpoint'][kind + 1] || ':' || begin || ':' || finish AS s FROM near
  WHERE strong OR NOT covered AND CASE kind WHEN 4 THEN by_ident WHEN 3 THEN by_secret ELSE by_ident AND by_secret END
), beside AS (
  SELECT *, {_nearest("1, 3", "ident")}, {_nearest("5", "endpoint")}
  FROM shown WINDOW up AS (PARTITION BY r ORDER BY begin, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY r ORDER BY begin DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), said AS (
  SELECT r, kind, begin, s, CASE WHEN kind IN (0, 2, 4) THEN {_choice("ident")} || '+' || s || coalesce('+' || {_choice("endpoint")}, '') END AS link FROM beside
), g AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
    string_agg(s, ',' ORDER BY begin, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY begin, kind) AS spans, string_agg(link, ',' ORDER BY begin, kind) AS links FROM said GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN g USING (r)
"""

#: CRC-32 of ASCII and Latin-1 text: the remainder is linear, so it is the exclusive or of what each byte adds at its
#: distance from the end (crc_part) and of what the start adds for the length (crc_start).
_CRC = """crc_byte AS (
  SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM (SELECT unnest(range(256)) AS b)
), crc_part AS (
  SELECT 0::BIGINT AS k, b, v FROM crc_byte
  UNION ALL SELECT p.k + 1, p.b, xor(p.v >> 8, t.v) FROM crc_part p JOIN crc_byte t ON t.b = p.v & 255 WHERE p.k < (SELECT max(n) FROM crc_text)
), crc_start AS (
  SELECT 0::BIGINT AS n, 4294967295 AS v
  UNION ALL SELECT s.n + 1, xor(s.v >> 8, t.v) FROM crc_start s JOIN crc_byte t ON t.b = s.v & 255 WHERE s.n < (SELECT max(n) FROM crc_text)
), crc AS (
  SELECT s, xor(xor(x, crc_start.v), 4294967295) AS h FROM (
    SELECT s, n, bit_xor(crc_part.v) AS x FROM (SELECT s, n, i, ('0x' || hexed[2 * i - 1:2 * i])::BIGINT AS b FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM crc_text)) c
    JOIN crc_part ON crc_part.k = n - i AND crc_part.b = c.b GROUP BY s, n
  ) JOIN crc_start USING (n)
)"""

OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL
), crc_text AS (
  SELECT DISTINCT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS hexed, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS n FROM runs WHERE length(w) >= 7
), {_CRC}, words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM runs JOIN crc ON s = coalesce(doc_id::VARCHAR, '') || ':' || w GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), cuts AS (
  SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other FROM cuts x JOIN cuts y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT word, a || b FROM cuts SEMI JOIN words v ON v.word = a || b
  UNION SELECT a || b, word FROM cuts SEMI JOIN words v ON v.word = a || b
), best AS (
  SELECT near.word, other, o.n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words o ON o.word = other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN other END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT forms.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN chain USING (word) JOIN (SELECT word AS root FROM forms WHERE form IS NULL) USING (root)
"""

OP12 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT r, doc_id, i, substr(x, 2 * i - 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(1, length(x) // 2 - 48)) AS i FROM d WHERE length(x) >= 100)
), gone AS (
  SELECT r, i FROM w SEMI JOIN (SELECT s, min(doc_id) AS doc_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)) f ON w.s = f.s AND w.doc_id > f.doc_id
), spans AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM gone)
  ) GROUP BY r, g
), kept AS (
  SELECT r, string_agg(substr(x, 2 * coalesce(before, 1) - 1, 2 * (a - coalesce(before, 1))), '' ORDER BY a) || any_value(substr(x, 2 * last - 1)) AS k, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM (SELECT r, a, b, lag(b) OVER (PARTITION BY r ORDER BY a) AS before, max(b) OVER (PARTITION BY r) AS last FROM spans) JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP13 = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM said
), crc_text AS (SELECT conv_id::VARCHAR AS s, hex(encode(conv_id::VARCHAR)) AS hexed, octet_length(encode(conv_id::VARCHAR)) AS n FROM ids
), {_CRC}, convs AS (SELECT conv_id, base, h % 6 AS h FROM ids JOIN crc ON s = conv_id::VARCHAR
), turns AS (
  SELECT c.conv_id, 0 AS part, place, said, size FROM convs c JOIN said b ON b.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, said, size FROM convs c JOIN said s ON s.conv_id = c.conv_id AND place > h
), path AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(said, '') OVER o AS node, size FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS owner, count(*) AS n, any_value(size) AS size FROM path GROUP BY node
), kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT a.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((b.n - 1) * b.size) AS saved
  FROM nodes b LEFT JOIN kids k ON k.node = b.node JOIN (SELECT node AS deep, unnest(range(0, depth + 1)) AS d FROM nodes) u ON u.deep = b.node JOIN nodes a ON a.node = left(b.node, 32 * d) GROUP BY a.node
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, node FROM path QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY node
)
SELECT n.owner AS conv_id, n.depth::BIGINT AS depth, p.owner AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, length(n.node) - 32) LEFT JOIN kids ON kids.node = n.node JOIN below ON below.node = n.node LEFT JOIN ends ON ends.node = n.node
"""


def _warc() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    # Own patterns: silent elements one after the other, tags told by what follows "<", blocks put together from trimmed lines.
    text = "regexp_replace(body, '(?s)<!--.*?-->', ' ', 'g')"
    for name in ("script", "style", "noscript", "template", "head"):
        text = f"regexp_replace({text}, {q(f'(?is)<{name}([[:space:]/][^>]*)?>.*?</{name}[[:space:]]*>')}, ' ', 'g')"
    text = f"regexp_replace({text}, {q('(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/table|/article|/section|/header|/footer|/nav|/aside)([[:space:]/][^>]*)?>')}, chr(10), 'g')"
    text = f"regexp_replace({text}, '<[A-Za-z/!?][^>]*>', ' ', 'g')"
    for name, to in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():  # all that the tables have
        text = f"replace({text}, {q(name)}, {q(to)})"
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g')))"
    text = f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"
    headers = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)"
    uuid = lambda kind, x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5('{kind}|' || {x}) AS h))"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (
  SELECT {uuid("response", "coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS refers_to, coalesce(url, '') AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT *, 'sha256:' || sha256(body) AS payload_digest, {headers} AS source_headers FROM r
), b AS (
  SELECT 'metadata' AS warc_type, {uuid("metadata", "refers_to")} AS record_id, refers_to, target_uri, warc_date, 'application/warc-fields' AS content_type, source_headers, payload_digest,
    'refers-to: ' || refers_to || {crlf} || 'payload-digest: ' || payload_digest || {crlf}
    || 'title: ' || trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g')) || {crlf}
    || 'outlinks: ' || len(regexp_extract_all(body, '(?i)<a\\s[^>]*href\\s*=')) || {crlf}
    || 'source-Content-Type: text/html; charset=utf-8' || {crlf} || 'source-Content-Length: ' || strlen(body) AS block
  FROM d
  UNION ALL
  SELECT 'conversion', {uuid("conversion", "refers_to")}, refers_to, target_uri, warc_date, 'text/plain; charset=utf-8', source_headers, payload_digest, {text} FROM d
)
SELECT *, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM b
"""


SQL = {"op2_warc_derivatives": _warc(), "op3_quality_cascade": OP3, "op4_wu_manber": OP4, "op5_line_dedup": OP5, "op9_credential_links": OP9, "op10_minhash_tensor": OP10, "op11_wildcard_groups": OP11, "op12_suffix_dedup": OP12, "op13_prefix_trie": OP13}
