"""DuckDB SQL for the queries that SQL can express, written as brute force from the definitions."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LINE = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

QUALITY = f"""
WITH d AS (SELECT doc_id, source, text, {WORDS.format("text")} AS w FROM documents),
each AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM each WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
win AS (SELECT doc_id, i, w[i:i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) AS r(j) GROUP BY 1),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
hosts AS (SELECT source, greatest(10, ceil(count(DISTINCT coalesce(text, '')) * 0.05)) AS least FROM documents GROUP BY 1),
lines AS (SELECT doc_id, source, text, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {LINE.format("x")})) AS line FROM documents),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY 1, 2) c JOIN hosts h USING (source) WHERE n >= least),
gone AS (SELECT doc_id, sum(len(string_split(lines.line, ' '))) AS n FROM lines JOIN often ON often.line = lines.line AND often.source IS NOT DISTINCT FROM lines.source GROUP BY 1)
SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(gone.n, 0) <= 0.5 * n_words AS kept,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM base LEFT JOIN gone USING (doc_id)"""

LINE_DEDUP = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT *, {LINE.format("line")} AS norm FROM raw),
each AS (SELECT norm, min((doc_id, pos)) AS first, string_split(norm, ' ') AS w FROM lines WHERE norm <> '' GROUP BY 1),
long AS (SELECT * FROM each WHERE len(w) >= 8),
cut AS (SELECT norm, first, len(w) AS n, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS rest FROM long, unnest(range(1, len(w) + 1)) AS r(i)),
swapped AS (SELECT norm FROM (SELECT norm, first, min(first) OVER (PARTITION BY n, i, rest) AS least FROM cut) WHERE least < first),
dropped AS (SELECT CASE WHEN cut.first < long.first THEN long.norm ELSE cut.norm END AS norm FROM cut JOIN long ON long.norm = cut.rest),
near AS (SELECT norm FROM swapped UNION SELECT norm FROM dropped),
verdict AS (SELECT lines.*, near.norm IS NOT NULL AS near, near.norm IS NULL AND each.norm IS NOT NULL AND (doc_id, pos) > first AS exact
  FROM lines LEFT JOIN each ON each.norm = lines.norm LEFT JOIN near ON near.norm = lines.norm)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT near AND NOT exact), '') AS text, count_if(exact) AS n_exact, count_if(near) AS n_near FROM verdict GROUP BY 1"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE shared >= 0.8 * (p.n + q.n - shared) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE x = doc_id) AS n_links FROM d"""

URL_FILTER = r"""
WITH c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') AS host,
  TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 360 AS INTEGER)) + to_hours(page_id % 24) AS tm FROM pages),
h AS (SELECT DISTINCT host AS domain, length(host) AS n, ascii(host) AS f FROM c WHERE host IS NOT NULL),
e AS (SELECT 'ads' AS list, domain, n, 'add' AS action, n * 7 % 200 AS day FROM h WHERE n % 3 = 0 UNION ALL SELECT 'ads', domain, n, 'remove', n * 7 % 200 + 60 FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'ads', domain, n, 'add', n * 7 % 200 + 90 FROM h WHERE n % 12 = 0 UNION ALL SELECT 'malware', domain, n, 'add', f % 50 + n FROM h WHERE f % 4 = 0 UNION ALL SELECT 'malware', domain, n, 'remove', f % 50 + n + 100 FROM h WHERE f % 8 = 0),
e2 AS (SELECT list, CASE WHEN n % 5 = 0 THEN array_to_string(string_split(domain, '.')[-3:], '.') ELSE domain END AS domain, action, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS tm FROM e),
e3 AS (SELECT list, domain, tm, min(action) AS action FROM e2 GROUP BY 1, 2, 3),
held AS (SELECT page_id, l.list, l.domain, arg_max(e3.action, e3.tm) AS action, max(e3.tm) AS since FROM c JOIN (SELECT DISTINCT list, domain FROM e3) l ON c.host = l.domain OR ends_with(c.host, '.' || l.domain)
  JOIN e3 ON e3.list = l.list AND e3.domain = l.domain AND e3.tm <= c.tm GROUP BY 1, 2, 3),
hit AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, arg_max(domain, (length(domain), domain, since)) AS matched, arg_max(since, (length(domain), domain, since)) AS since FROM held WHERE action = 'add' GROUP BY 1)
SELECT c.page_id, host, hit.page_id IS NOT NULL AS blocked, coalesce(lists, '') AS lists, matched, strftime(since, '%Y-%m-%d') AS listed_since FROM c LEFT JOIN hit USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": QUALITY, "op2_line_dedup": LINE_DEDUP, "op6_topk": TOP_K, "op7_near_duplicates": NEAR_DUPLICATES, "op10_url_filter": URL_FILTER}
