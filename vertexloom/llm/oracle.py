"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from vertexloom.llm import url_filter as U
from vertexloom.llm.licenses import COMMENT, FIXED, LICENCE_FILE, MIN_COSINE, NOTICE, RESERVED, WORD


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_text(a)}, {_text(b)})" for i, (a, b) in enumerate(FIXED))

LICENSES = f"""
WITH templates(template, license, text) AS (VALUES {_VALUES}),
counted AS (
  SELECT template, any_value(license) AS license, word, count(*) AS n
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), {_text(WORD)})) AS word FROM templates)
  GROUP BY template, word),
idf AS (SELECT word, ln(1 + (SELECT count(*) FROM templates) / count(*)) AS idf FROM counted GROUP BY word),
norms AS (SELECT template, sqrt(sum(n * idf * n * idf)) AS norm FROM counted JOIN idf USING (word) GROUP BY template),
theirs AS (
  SELECT template, license, word, n * idf / norm AS w FROM counted JOIN idf USING (word) JOIN norms USING (template)),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
    CASE WHEN doc_id % 10000 = 0 THEN concat_ws('/', src, 'LICENSE')
         WHEN doc_id % 1000 = 0 THEN concat_ws('/', src, doc_id // 1000, 'LICENSE')
         WHEN doc_id % 100 = 0 THEN concat_ws('/', src, doc_id // 1000, doc_id // 100, 'LICENSE')
         ELSE concat_ws('/', src, doc_id // 1000, doc_id // 100, doc_id || '.txt') END AS path
  FROM (SELECT *, coalesce(source, 'unknown') AS src FROM documents)),
lines AS (
  SELECT path, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM (SELECT DISTINCT path, text FROM files WHERE regexp_matches(text, {_text(NOTICE)}))),
flagged AS (
  SELECT *, regexp_matches(line, {_text(COMMENT)}) AS c, NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS e FROM lines),
edges AS (
  SELECT *, c IS DISTINCT FROM lag(c) OVER w AS turns, coalesce(lag(e) OVER w, false) AS gap
  FROM flagged WINDOW w AS (PARTITION BY path, text ORDER BY i)),
numbered AS (
  SELECT *, count_if(turns) OVER w AS block, count_if(turns OR gap) OVER w AS paragraph
  FROM edges WINDOW w AS (PARTITION BY path, text ORDER BY i)),
parts AS (
  SELECT path, text, line AS part FROM lines
  UNION ALL SELECT path, text, string_agg(line, chr(10) ORDER BY i) FROM numbered GROUP BY path, text, block
  UNION ALL SELECT path, text, string_agg(line, chr(10) ORDER BY i) FROM numbered WHERE NOT e GROUP BY path, text, paragraph),
units AS (
  SELECT DISTINCT path, text, lower(part) AS unit FROM parts WHERE regexp_matches(part, {_text(NOTICE)})
  UNION SELECT path, text, lower(text) FROM files WHERE regexp_matches(path, {_text(LICENCE_FILE)})),
ours AS (
  SELECT unit, word, n * coalesce(idf, ln(1 + (SELECT count(*) FROM templates))) AS w FROM (
    SELECT unit, word, count(*) AS n
    FROM (SELECT unit, unnest(regexp_extract_all(unit, {_text(WORD)})) AS word FROM (SELECT DISTINCT unit FROM units))
    GROUP BY unit, word)
  LEFT JOIN idf USING (word)),
our_norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM ours GROUP BY unit),
dots AS (
  SELECT unit, template, any_value(license) AS license, sum(o.w * t.w) AS dot
  FROM ours o JOIN theirs t USING (word) GROUP BY unit, template),
scores AS (
  SELECT unit, arg_min(license, (-round(dot / norm, 6), license)) AS license, max(round(dot / norm, 6)) AS score
  FROM dots JOIN our_norms USING (unit) GROUP BY unit HAVING max(round(dot / norm, 6)) >= {MIN_COSINE}),
own AS (
  SELECT path, text, arg_min(license, (license = {_text(RESERVED)}, -score, license)) AS license,
    arg_min(score, (license = {_text(RESERVED)}, -score, license)) AS score
  FROM units JOIN scores USING (unit) GROUP BY path, text),
up AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, arg_min(struct_pack(l := license, s := score, p := path), (-score, license, path)) AS u
  FROM own WHERE regexp_matches(path, {_text(LICENCE_FILE)}) GROUP BY above),
inherited AS (
  SELECT directory, arg_max(u, length(above)) AS u
  FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS directory FROM files)
  JOIN up ON directory = above OR starts_with(directory, above || '/') GROUP BY directory)
SELECT doc_id, f.path, coalesce(o.license, u.l) AS license, coalesce(o.score, u.s, 0.0) AS score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN u IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN f.path ELSE u.p END AS license_path
FROM files f LEFT JOIN own o ON f.path = o.path AND f.text = o.text
LEFT JOIN inherited i ON regexp_replace(f.path, '/[^/]*$', '') = i.directory
"""

HARD_NEGATIVES = """
WITH own AS (
  SELECT vec_id, min(struct_pack(l := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, v := embedding::DOUBLE[])) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id),
rows AS (SELECT vec_id, r.l AS label, list_transform(r.v, lambda x: floor(256.0 * x)) AS v FROM own),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT alike
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _lower(column: str) -> str:
    return f"translate({column}, '{U.UPPER}', '{U.LOWER}')"


def _part(url: str, part: int) -> str:
    return f"coalesce(regexp_extract({url}, {_text(U.URL)}, {part}), '')"


def _identity(url: str, query: str) -> str:
    """SQL of a url's identity with another query."""
    return f"{_lower(_part(url, 1))} || '://' || {_lower(_part(url, 2))} || {_part(url, 3)} || {query}"


_QUERY = f"regexp_replace({_part('node', 4)}, {_text(U.TRACKING)}, '', 'g')"

URL_FILTER = f"""
WITH RECURSIVE rules(host, path, allow) AS (
  VALUES ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true),
    ('net', '/es/', false), ('net', '/fr/', false)),
own AS (
  SELECT page_id, url, {_lower(_part('url', 2))} AS host, {_part('url', 3)} AS path,
    CASE WHEN contains(url, '://') THEN {_identity('url', _part('url', 4))} END AS node,
    {_part('url', 1)} AS scheme, {_part('url', 1)} || '://' || {_part('url', 2)} AS site,
    regexp_extract_all(coalesce(html, ''), {_text(U.TAGS)}) AS tags
  FROM pages),
hrefs AS (
  SELECT node, path, scheme, site, replace(href, '&amp;', '&') AS href FROM (
    SELECT * EXCLUDE tags, unnest(list_concat(
      list_transform(list_filter(tags, lambda t: regexp_matches(t, {_text(U.CANONICAL)})), lambda t: regexp_extract(t, {_text(U.HREF)}, 1)),
      list_transform(list_filter(tags, lambda t: regexp_matches(t, {_text(U.REFRESH)})), lambda t: regexp_extract(t, {_text(U.TARGET)}, 1)))) AS href
    FROM own)),
targets AS (
  SELECT node, CASE WHEN href = '' OR starts_with(href, '#') THEN NULL
    WHEN regexp_matches(href, {_text(U.ABSOLUTE)}) THEN href
    WHEN regexp_matches(href, {_text(U.OTHER_SCHEME)}) THEN NULL
    WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '/') THEN site || href
    ELSE site || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || href END AS target
  FROM hrefs),
edges AS (
  SELECT node AS src, {_identity('target', _part('target', 4))} AS dst FROM targets WHERE contains(target, '://')
  UNION SELECT node, {_identity('node', f"CASE WHEN starts_with({_QUERY}, '&') THEN '?' || substr({_QUERY}, 2) ELSE {_QUERY} END")}
  FROM own WHERE contains(node, 'utm_')),
ways AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(node, other) AS (
  SELECT src, src FROM ways UNION SELECT node, dst FROM reach JOIN ways ON other = src),
ruled AS (
  SELECT key, r.host || r.path AS rule, allow FROM (
    SELECT DISTINCT host || path AS key, host, path FROM own
    UNION SELECT {_lower(_part('other', 2))} || {_part('other', 3)}, {_lower(_part('other', 2))}, {_part('other', 3)} FROM reach) u
  JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(rule) DESC, allow DESC, rule DESC) = 1),
blocked AS (
  SELECT DISTINCT node FROM reach JOIN ruled ON {_lower(_part('other', 2))} || {_part('other', 3)} = key AND NOT allow)
SELECT page_id, host, path, rule,
  CASE WHEN coalesce(allow, b.node IS NULL) THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN b.node IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM own LEFT JOIN ruled ON host || path = key LEFT JOIN blocked b USING (node)
"""

ALL = {"op4_licenses": LICENSES, "op11_hard_negatives": HARD_NEGATIVES, "op12_url_filter": URL_FILTER}
