"""DuckDB SQL for the queries of ``catalog``, over the same Parquet views. Written from the definitions, not from plans."""

from __future__ import annotations


def symbols(fine: bool) -> str:
    name = "replace(p_name, ' ', '_')" + (" || '_' || (p_partkey % 97)" if fine else "")
    return f"""
p0 AS (SELECT *, {name} AS name, upper(p_type[1]) || lower(p_type[2:]) AS owner,
  (CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'src/' END) || lower(replace(p_brand, '#', '_')) || '/mod_' || p_size || '.py' AS path,
  10 * row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS start_line FROM part),
p1 AS (SELECT *, CASE WHEN p_type = 'STANDARD' THEN name ELSE owner || '.' || name END AS qualname,
  CASE WHEN p_type = 'STANDARD' THEN 'function' ELSE 'method' END AS kind FROM p0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY path, qualname ORDER BY start_line) AS nth FROM p1),
sym AS (SELECT p_partkey, path || '::' || qualname || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id, name, qualname, kind, path,
  CAST(start_line AS INTEGER) AS start_line, CAST(start_line + 8 AS INTEGER) AS end_line, p_partkey % 11 = 0 AS decorated, p_partkey % 13 = 0 AS exported,
  path LIKE 'tests/%' AS test, regexp_replace(path, '/[^/]*$', '') AS dir,
  CASE WHEN p_partkey % 3 = 0 THEN 'ring: Optional[' || ['Small', 'Large', 'Medium', 'Economy', 'Promo'][p_partkey % 5 + 1] || ']' END AS param,
  CASE WHEN p_partkey % 3 = 0 THEN ['Small', 'Large', 'Medium', 'Economy', 'Promo'][p_partkey % 5 + 1] END AS ring_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'int' END AS returns FROM p2),
pr AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
  l_quantity, CAST(l_orderkey % 500 + 1 AS INTEGER) AS line, l_returnflag, l_discount FROM lineitem) WHERE dst IS NOT NULL AND l_quantity >= 46),
np AS (SELECT pr.*, a.id AS src_id, a.path AS src_path, a.qualname AS src_qualname, a.ring_type, b.id AS dst_id, b.name AS dst_name, b.path AS dst_path
  FROM pr JOIN sym a ON a.p_partkey = src JOIN sym b ON b.p_partkey = dst),
re AS (SELECT src_id AS caller, dst_id AS callee, line FROM np WHERE src <> dst),
ed AS (SELECT caller, callee, list_sort(list(DISTINCT line)) AS lines FROM re WHERE caller <> callee GROUP BY ALL),
me AS (SELECT caller, callee, list_sort(list(DISTINCT line)) AS lines FROM (SELECT CASE WHEN line % 50 <> 0 THEN src_id ELSE src_path || '::<module>' END AS caller, dst_id AS callee, line FROM np) WHERE caller <> callee GROUP BY ALL),
im AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY source) AS ordinal FROM
  (SELECT DISTINCT src_path AS path, dst_name AS name, replace(replace(dst_path, '.py', ''), '/', '.') || '.' || dst_name AS source FROM np WHERE l_discount >= 0.05)),
i1 AS (SELECT path, name, source FROM im WHERE ordinal = 1),
rc AS (SELECT CASE WHEN line % 50 <> 0 THEN src_id END AS caller_id, src_path AS path, CASE WHEN line % 50 <> 0 THEN src_id ELSE src_path || '::<module>' END AS caller,
  CASE WHEN line % 50 <> 0 THEN src_qualname END AS caller_qualname, CASE WHEN line % 50 <> 0 THEN ring_type END AS ring_type, dst_name AS name,
  CASE l_returnflag WHEN 'A' THEN 'self' WHEN 'R' THEN 'ring' END AS receiver, line FROM np),
deg AS (SELECT sym.*, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM sym
  LEFT JOIN (SELECT callee, count(DISTINCT caller) AS n FROM ed GROUP BY 1) i ON i.callee = id LEFT JOIN (SELECT caller, count(DISTINCT callee) AS n FROM ed GROUP BY 1) o ON o.caller = id),
fi AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS path, lang AS language, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1] AS doc, n_chars AS size, sha256(text)[1:16] AS content_hash, doc_id FROM documents),
ex AS (SELECT url || '::<module>' AS caller, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS callee FROM pages),
cm AS (SELECT event_id, path, ts FROM events JOIN sym ON p_partkey = user_id % (SELECT count(*) FROM part)),
tr AS (SELECT conv_id AS session_id, turn AS seq, role = 'assistant' AS asst, CASE WHEN turn % 7 <> 3 AND role = 'assistant' THEN length(text) END AS usage, length(text) // 4 AS estimate,
  (conv_id * 31 + turn) % 2000 AS part, CASE WHEN turn % 3 <> 0 THEN CAST(turn * 10 AS INTEGER) END AS lo, CASE WHEN turn % 3 = 2 THEN 30 END AS lim FROM conversations),
rd AS (SELECT tr.*, sym.path FROM tr JOIN sym ON p_partkey = part % (SELECT count(*) FROM part)),
seen AS (SELECT DISTINCT session_id, rd.path, id FROM rd JOIN sym ON sym.path = rd.path WHERE (lo IS NULL AND lim IS NULL) OR (start_line >= coalesce(lo, 1) AND (lim IS NULL OR start_line < coalesce(lo, 1) + lim))),
nt AS (SELECT coalesce(id, 'gone::' || doc_id) AS symbol_id, 'quality ' || quality AS text FROM labels LEFT JOIN sym ON p_partkey = doc_id)"""


SIG = "qualname || '(' || coalesce(param, '') || ')' || coalesce(' -> ' || returns, '')"
SEGMENTS = "list_filter(string_split(regexp_replace({}, '::|/', '.', 'g'), '.'), lambda x: x <> '' AND x NOT IN ('crate', 'super', 'self'))"
STEM = "regexp_replace(regexp_extract({}, '[^/]*$'), '\\.[^.]*$', '')"
#: All rungs of the ladder from raw calls rc, symbols s and first imports i.
LADDER = f"""
cand AS (SELECT name, count(*) AS n, min(id) AS one FROM sym GROUP BY 1),
samef AS (SELECT name, path, count(*) AS n, min(id) AS one FROM sym GROUP BY 1, 2),
cont AS (SELECT name, path, qualname, count(*) AS n, min(id) AS one FROM sym GROUP BY 1, 2, 3),
qual AS (SELECT name, qualname, count(*) AS n, min(id) AS one FROM sym GROUP BY 1, 2),
stems AS (SELECT name, {STEM.format("path")} AS stem, id FROM sym),
hint AS (SELECT h.name, h.source, count(*) AS n, min(id) AS one FROM (SELECT DISTINCT name, source FROM i1) h JOIN stems ON stems.name = h.name AND list_contains({SEGMENTS.format("h.source")}, stem) GROUP BY 1, 2),
lad AS (SELECT rc.*, coalesce(cand.n, 0) AS n_candidates,
  CASE WHEN cont.n = 1 THEN cont.one END AS container, CASE WHEN qual.n = 1 THEN qual.one END AS typed, CASE WHEN samef.n = 1 THEN samef.one END AS same_file,
  CASE WHEN hint.n = 1 THEN hint.one END AS hint, CASE WHEN cand.n = 1 THEN cand.one END AS "only"
  FROM rc LEFT JOIN cand USING (name) LEFT JOIN samef ON samef.name = rc.name AND samef.path = rc.path
  LEFT JOIN cont ON receiver = 'self' AND contains(caller_qualname, '.') AND cont.name = rc.name AND cont.path = rc.path AND cont.qualname = string_split(caller_qualname, '.')[1] || '.' || rc.name
  LEFT JOIN qual ON receiver = 'ring' AND qual.name = rc.name AND qual.qualname = ring_type || '.' || rc.name
  LEFT JOIN i1 ON i1.path = rc.path AND i1.name = rc.name LEFT JOIN hint ON hint.name = rc.name AND hint.source = i1.source),
won AS (SELECT *, coalesce(container, typed, same_file, hint, "only") AS target FROM lad)"""
GRAPH = "SELECT caller, target AS callee, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM won WHERE target IS NOT NULL AND target <> caller GROUP BY 1, 2"
OLD = "(SELECT id, path, qualname, sha256(CAST(CASE WHEN p_partkey % 29 = 0 THEN p_partkey + 1 ELSE p_partkey END AS VARCHAR))[1:16] AS h FROM sym WHERE p_partkey % 23 <> 0)"
NEW = "(SELECT id, path, qualname, sha256(CAST(p_partkey AS VARCHAR))[1:16] AS h FROM sym WHERE p_partkey % 31 <> 0)"
DIFF = f"""df AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS change,
  coalesce(n.path, o.path) AS path, coalesce(n.qualname, o.qualname) AS qualname FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id)"""
SEVEN = "(SELECT id FROM sym WHERE p_partkey = 7)"


def hops(seeds: str) -> str:
    """Least hops by a keyed recursion, which replaces nothing once found."""
    return f"""walk(id, hop) USING KEY (id) AS (SELECT id, 0 FROM ({seeds}) UNION SELECT DISTINCT ed.caller, walk.hop + 1 FROM walk JOIN ed ON ed.callee = walk.id WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.id = ed.caller))"""


LEX = """asked AS (SELECT unnest(['red', 'widget', 'gear', 'bol']) AS t),
ct AS (SELECT id, path, fan_in, list_distinct(list_filter(list_transform(regexp_extract_all(qualname || ' ' || path, '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('the', 'a', 'an', 'to', 'of', 'in', 'on', 'and', 'or', 'for', 'is', 'it', 'this', 'that', 'with', 'as', 'at', 'by', 'be', 'add', 'use', 'fix', 'make'))) AS terms FROM deg),
lx AS (SELECT id, path, fan_in, sum(CASE WHEN list_contains(terms, t) THEN 2 WHEN length(t) >= 3 AND len(list_filter(terms, lambda x: contains(x, t))) > 0 THEN 1 ELSE 0 END) AS raw2 FROM ct, asked GROUP BY 1, 2, 3)"""
MANY = "mn AS (SELECT callee FROM (SELECT callee, count(*) AS n FROM ed GROUP BY 1) ORDER BY n DESC, callee LIMIT 1), cl AS (SELECT deg.* FROM deg WHERE id IN (SELECT caller FROM ed WHERE callee = (SELECT callee FROM mn)))"
FIT = MANY + """, ft AS (SELECT id, row_number() OVER w AS rank, (sum(length(id) + 1) OVER w + {prefix}) // 4 AS cost FROM (SELECT * FROM cl ORDER BY test, degree DESC, path, start_line LIMIT 50) WINDOW w AS (ORDER BY test, degree DESC, path, start_line ROWS UNBOUNDED PRECEDING)),
kp AS (SELECT * FROM ft WHERE cost <= 60 OR rank = 1)"""
CHURN = "mx AS (SELECT max(ts) AS m FROM cm), ch AS (SELECT path, count(*) AS commits FROM cm, mx WHERE ts >= m - INTERVAL 20 DAY GROUP BY 1)"
READ_FILES = "rf AS (SELECT session_id, path, bool_or(lo IS NULL AND lim IS NULL) AS fully_read FROM rd GROUP BY 1, 2)"
SESSIONS = "ss AS (SELECT session_id, count_if(asst) AS turns, CAST(coalesce(max(usage), sum(estimate), 0) AS BIGINT) AS consumed FROM tr GROUP BY 1)"
CLASSES = "cs AS (SELECT 'C' || p_partkey AS name, path || '::C' || p_partkey AS id FROM sym WHERE p_partkey % 7 = 0 AND kind = 'function')"

VERDICTS = """fv AS (SELECT CASE WHEN p LIKE '%5.txt' THEN 'excluded' WHEN p LIKE '%.astro' THEN 'no parser (astro)' WHEN size > 4000 THEN 'too large' ELSE 'ok' END AS verdict
  FROM (SELECT size, CASE WHEN doc_id % 7 = 0 THEN replace(path, '.txt', '.astro') ELSE path END AS p FROM fi))"""
DIRS = "dg AS (SELECT DISTINCT a.dir AS src, b.dir AS dst FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee WHERE a.dir <> b.dir)"
DOC = "'Handles ' || path || ' and whatever else belongs to it in the folder of its brand'"


def short(text: str, width: int) -> str:
    return f"CASE WHEN length({text}) <= {width} THEN {text} ELSE rtrim(({text})[1:{width - 1}]) || '…' END"


FOLDED = "dir || '/  (' || n || CASE WHEN n = 1 THEN ' file)' ELSE ' files)' END"


def lean(budget: str, dense: bool, known: str) -> str:
    """The lean map by totals: what each rung leaves, and each symbol's form by running sums."""
    width = lambda w: f"(length('  ' || base || {"'  ' || " + short("purpose", w) if w else "''"}) + 1) // 4"
    sums = ", ".join(f"coalesce(sum({width(w)}) FILTER ({'test' if t else 'NOT test'}), 0) AS w{w}{t}" for w in (72, 40, 0) for t in (0, 1))
    return f"""{CHURN}, {DIRS},
lf AS (SELECT DISTINCT path, dir, test, regexp_extract(path, '[^/]*$') AS base, {short(DOC, 72)} AS purpose FROM sym),
ld AS (SELECT dir, test, count(*) AS n FROM lf GROUP BY 1, 2),
la AS (SELECT id, deg.path, dir, test, start_line, qualname, name, {SIG} AS sig, fan_in * (1 + coalesce(commits, 0) / (SELECT max(commits) FROM ch)) AS score, {known} AS known FROM deg LEFT JOIN ch ON ch.path = deg.path),
lp AS (SELECT *, CASE WHEN known THEN 0 ELSE (length(sig) + 5) // 4 END AS s, CASE WHEN known THEN 0 ELSE (length(name) + 5) // 4 END AS n FROM la),
lv AS (SELECT *, row_number() OVER o AS r, count(*) OVER () AS total, coalesce(sum(s - n) OVER b, 0) AS bs, coalesce(sum(n) OVER b, 0) AS bn FROM lp WHERE NOT test
  WINDOW o AS (ORDER BY score, id), b AS (ORDER BY score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ll AS (SELECT src, '  ' || src || '/ → ' || string_agg(dst || '/', ', ' ORDER BY dst) AS line FROM dg GROUP BY 1),
mn AS (SELECT name, 'n' || (row_number() OVER (ORDER BY name) - 1) AS n FROM (SELECT src AS name FROM dg UNION SELECT dst FROM dg)),
ml AS (SELECT n || '["' || name || '"]' AS line FROM mn UNION ALL SELECT x.n || ' --> ' || y.n FROM dg JOIN mn x ON x.name = src JOIN mn y ON y.name = dst),
k0 AS (SELECT count(*) AS files, count_if(NOT test) AS prod, {sums} FROM lf),
k1 AS (SELECT coalesce(sum((length(dir) + 2) // 4) FILTER (NOT test), 0) AS hp, coalesce(sum((length(dir) + 2) // 4) FILTER (test), 0) AS ht, coalesce(sum((length({FOLDED}) + 1) // 4) FILTER (test), 0) AS fo FROM ld),
k2 AS (SELECT coalesce(sum(s) FILTER (test), 0) AS ta FROM lp),
k3 AS (SELECT coalesce(sum(CASE WHEN {dense} AND r <= total - 30 THEN n ELSE s END), 0) AS sg, coalesce(sum(n), 0) AS nm, count_if(known) AS known, coalesce(sum(s - n) FILTER ({dense} AND r <= total - 30), 0) AS dn FROM lv),
k4 AS (SELECT CASE WHEN count(*) > 0 THEN sum((length(line) + 1) // 4) + 3 ELSE 0 END AS lk, count(*) AS nl FROM ll),
k5 AS (SELECT CASE WHEN (SELECT count(*) FROM mn) BETWEEN 1 AND 40 THEN 3 + (9 + sum(length(line) + 1)) // 4 ELSE 0 END AS dc FROM ml),
k6 AS (SELECT *, greatest(coalesce({budget}, least(12000, 3000 + 12 * files)), hp + w00 + fo + 64) AS cap FROM k0, k1, k2, k3, k4, k5),
k7 AS (SELECT *, cap - 64 AS room, hp + w720 + ht + w721 + ta + sg + lk AS whole FROM k6),
k8 AS (SELECT *, whole + dc <= room AS m, whole + dc > room AND whole > room AS folded FROM k7),
k9 AS (SELECT *, hp + w720 + CASE WHEN folded THEN fo ELSE ht + w721 + ta END + lk + CASE WHEN m THEN dc ELSE 0 END AS rest FROM k8),
fm AS (SELECT lv.*, ({dense} AND r <= total - 30) OR rest + sg - (bs - CASE WHEN {dense} THEN dn ELSE 0 END) > room AS no_sig, rest + nm > room AND rest + nm - bn > room AS no_name FROM lv, k9),
ff AS (SELECT *, CASE WHEN known OR no_name THEN 'none' WHEN no_sig THEN 'name' ELSE 'sig' END AS form FROM fm),
ka AS (SELECT coalesce(sum(CASE form WHEN 'sig' THEN s WHEN 'name' THEN n ELSE 0 END), 0) AS c, count_if(no_sig) AS nosig, count_if(no_name) AS noname, count_if(form <> 'none') AS shown FROM ff),
kb AS (SELECT *, rest + c <= room AS linked, rest + c - CASE WHEN rest + c <= room THEN 0 ELSE lk END AS now, w720 + CASE WHEN folded THEN 0 ELSE w721 END AS p72, w400 + CASE WHEN folded THEN 0 ELSE w401 END AS p40 FROM k9, ka),
kc AS (SELECT *, CASE WHEN now <= room THEN 72 WHEN now - p72 + p40 <= room THEN 40 ELSE 0 END AS width FROM kb)"""


LEAN_LINES = f"""SELECT 'files' AS section, dir, '' AS path, 0 AS position, CASE WHEN test AND (SELECT folded FROM kc) THEN {FOLDED} ELSE dir || '/' END AS line FROM ld
UNION ALL SELECT 'files', dir, path, 0, '  ' || base || CASE (SELECT width FROM kc) WHEN 72 THEN '  ' || purpose WHEN 40 THEN '  ' || {short("purpose", 40)} ELSE '' END FROM lf WHERE NOT (test AND (SELECT folded FROM kc))
UNION ALL SELECT 'files', dir, path, position, '    ' || CASE form WHEN 'sig' THEN sig ELSE name END FROM
  (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, qualname, id) AS position FROM (SELECT dir, path, test, start_line, qualname, id, sig, name, form FROM ff UNION ALL SELECT dir, path, test, start_line, qualname, id, sig, name, 'sig' FROM lp WHERE test AND NOT known))
  WHERE form <> 'none' AND NOT (test AND (SELECT folded FROM kc))"""
LEAN_EDGES = "UNION ALL SELECT 'edges', '', '', 0, 'module edges:' WHERE (SELECT linked AND nl > 0 FROM kc) UNION ALL SELECT 'edges', src, '', 1, line FROM ll WHERE (SELECT linked FROM kc)"


def packs(budget: int | None, notes: bool = False, source: bool = False, scores: bool = False) -> str:
    """Packs of all symbols by brute force: the cost of a pack after each number of rows that could leave, and the first
    that fits."""
    note = "UNION ALL SELECT symbol_id, 0, 2 + row_number() OVER (PARTITION BY symbol_id ORDER BY text), '  note: ' || text, NULL, 0, 0, 0, '', NULL, false FROM nt JOIN sym ON symbol_id = id" if notes else ""
    sites = "(SELECT string_agg(chr(10) || '      > ' || x || ': line ' || x, '' ORDER BY x) FROM (SELECT unnest(me.lines[1:3]) AS x FROM me WHERE me.caller = en.id AND me.callee = en.target AND en.d = 0))"
    body = f"""UNION ALL SELECT id, 1, n, '      line ' || n, 2, -n, 0, 0, '', NULL, false FROM sym, unnest(range(start_line, least(end_line, 500) + 1)) AS r(n)
UNION ALL SELECT id, 1, 0, 'source:', NULL, 0, 0, 0, '', NULL, true FROM sym WHERE start_line <= 500""" if source else ""  # fmt: skip
    lexical = """qt AS (SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('the', 'a', 'an', 'to', 'of', 'in', 'on', 'and', 'or', 'for', 'is', 'it', 'this', 'that', 'with', 'as', 'at', 'by', 'be', 'add', 'use', 'fix', 'make'))) AS terms FROM (SELECT id, qualname || ' ' || {sig} AS text FROM sym)),
qr AS (SELECT id, sum(CASE WHEN list_contains(terms, t) THEN 1.0 WHEN length(t) >= 3 AND len(list_filter(terms, lambda x: contains(x, t))) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS raw FROM qt, (SELECT unnest(['red', 'widget', 'gear', 'bol']) AS t) GROUP BY 1),
sc AS (SELECT target, id, 0.5::DOUBLE * CASE WHEN top > 0 THEN raw / top ELSE 0 END + 0.5::DOUBLE * CASE WHEN hi > lo THEN (degree - lo)::DOUBLE / (hi - lo) ELSE 0 END AS score FROM
  (SELECT target, nb.id, raw, degree, max(raw) OVER w AS top, min(degree) OVER w AS lo, max(degree) OVER w AS hi FROM nb JOIN qr USING (id) JOIN dm USING (id) WINDOW w AS (PARTITION BY target))),""".replace("{sig}", SIG) if scores else ""  # fmt: skip
    return f"""dm AS (SELECT id, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM sym LEFT JOIN (SELECT callee, count(*) AS n FROM me GROUP BY 1) i ON callee = id LEFT JOIN (SELECT caller, count(*) AS n FROM me GROUP BY 1) o ON caller = id),
nb AS (SELECT target, id, min(d) AS d FROM (SELECT callee AS target, caller AS id, 0 AS d FROM me UNION ALL SELECT caller, callee, 1 FROM me WHERE caller NOT LIKE '%::<module>') GROUP BY 1, 2),
{lexical}
en AS (SELECT target, nb.id, d, sym.path, start_line AS line, {SIG} AS sig, degree, CAST(NULL AS VARCHAR) AS mpath FROM nb JOIN sym USING (id) JOIN dm USING (id)
  UNION ALL SELECT target, nb.id, d, replace(nb.id, '::<module>', ''), unnest(lines), '<anonymous> (' || replace(nb.id, '::<module>', '') || ')', (SELECT count(*) FROM me y WHERE y.caller = nb.id), replace(nb.id, '::<module>', '') FROM nb JOIN me ON me.caller = nb.id AND callee = target WHERE nb.id LIKE '%::<module>'),
el AS (SELECT en.*, '  [1] ' || path || ':' || line || '  ' || sig {"|| coalesce(" + sites + ", '')" if source else ""} AS text {", coalesce(score, 0)" if scores else ", 0"} AS score FROM en {"LEFT JOIN sc ON sc.target = en.target AND sc.id = en.id" if scores else ""}),
hd AS (SELECT id AS target, path, 1 AS pos, {SIG} AS text FROM sym UNION ALL SELECT id, path, 2, '  ' || kind || ' (python) at ' || path || ':' || start_line || '-' || end_line FROM sym {"UNION ALL SELECT id, path, 3, text FROM sym JOIN nt ON symbol_id = id" if notes else ""}),
wd AS (SELECT DISTINCT target, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS name FROM (SELECT target, text FROM hd UNION ALL SELECT target, text FROM el)),
ip AS (SELECT sym.id AS target, sym.path, im.ordinal, im.name, im.source, wd.name IS NOT NULL AS hit FROM sym JOIN im ON im.path = sym.path LEFT JOIN wd ON wd.target = sym.id AND wd.name = im.name),
ic AS (SELECT target, path, count_if(NOT hit) AS more FROM ip GROUP BY 1, 2),
rw0(target, sec, pos, text, stage, ka, kb, kc, kd, mpath, title) AS (SELECT id, 0, 0, 'context: ' || path || ':' || qualname, CAST(NULL AS INTEGER), 0::DOUBLE, 0, 0, '', CAST(NULL AS VARCHAR), false FROM sym
  UNION ALL SELECT target, 0, pos, text, NULL, 0, 0, 0, '', NULL, false FROM hd WHERE pos < 3 {note} {body}
  UNION ALL SELECT target, 2, 0, 'imports (' || path || '):', NULL, 0, 0, 0, '', NULL, more = 0 FROM ic
  UNION ALL SELECT target, 2, 1 << 30, '  +' || more || ' more imports (irrelevant to this pack)', NULL, 0, 0, 0, '', NULL, false FROM ic WHERE more > 0
  UNION ALL SELECT target, 2, ordinal, '  ' || name || '  (from ' || source || ')', 0, -ordinal, 0, 0, name, NULL, false FROM ip WHERE hit
  UNION ALL SELECT target, 4 + d, row_number() OVER (PARTITION BY target, d ORDER BY path, line, id), text, 1, score, -1, degree, CASE d WHEN 0 THEN 'caller|' ELSE 'callee|' END || id || '|' || lpad(line::VARCHAR, 9, '0'), mpath, false FROM el
  UNION ALL SELECT DISTINCT target, 4 + d, 0, CASE d WHEN 0 THEN 'callers:' ELSE 'callees:' END, NULL, 0, 0, 0, '', NULL, true FROM el),
rw AS (SELECT *, CASE WHEN stage IS NOT NULL THEN row_number() OVER (PARTITION BY target ORDER BY stage NULLS LAST, ka, kb, kc, kd) END AS leaves FROM rw0),
sx AS (SELECT target, sec, max(leaves) AS last, min(leaves) AS first FROM rw GROUP BY 1, 2), px AS (SELECT target, mpath, max(leaves) AS last FROM rw WHERE mpath IS NOT NULL GROUP BY 1, 2),
ms AS (SELECT target, unnest(range(0, coalesce(max(leaves), 0) + 1)) AS m FROM rw GROUP BY 1),
sh AS (SELECT ms.target, m, rw.sec, pos, text FROM ms JOIN rw ON rw.target = ms.target JOIN sx ON sx.target = rw.target AND sx.sec = rw.sec WHERE (NOT title AND (leaves IS NULL OR leaves > m)) OR (title AND coalesce(last, 0) > m)
  UNION ALL SELECT ms.target, m, 1, 1 << 30, '  … (source truncated)' FROM ms JOIN sx ON sx.target = ms.target AND sec = 1 WHERE first <= m AND last > m
  UNION ALL SELECT ms.target, m, 6, 0, 'module-level callers: ' || string_agg(mpath, ', ' ORDER BY mpath) FROM ms JOIN px ON px.target = ms.target AND last <= m GROUP BY 1, 2),
co AS (SELECT target, m, (sum(length(text) + 1) - 1) // 4 AS cost FROM sh GROUP BY 1, 2),
pk AS (SELECT target, {"0" if budget is None else f"coalesce(min(m) FILTER (cost <= {budget}), max(m))"} AS m FROM co GROUP BY 1),
ch2 AS (SELECT sh.* FROM sh JOIN pk USING (target, m))"""


PACK_TEXT = "SELECT target, (sum(length(text) + 1) - 1) // 4 AS tokens, md5(string_agg(text, chr(10) ORDER BY sec, pos, text)) AS text FROM ch2 GROUP BY 1"
#: name: (fine names?, further tables, SELECT)
BODIES: dict[str, tuple[bool, str, str]] = {
    "symbols_scan": (False, "", "SELECT id, name, qualname, kind, path, start_line, end_line, decorated, exported, test FROM sym"),
    "files_scan": (False, "", "SELECT path, language, doc, size, content_hash FROM fi"),
    "skipped_verdicts": (False, VERDICTS, "SELECT verdict, count(*) AS n FROM fv GROUP BY 1"),
    "test_path_filter": (False, "", "SELECT id, path FROM sym WHERE test"),
    "prod_view_edges": (False, "", "SELECT caller, callee, array_to_string(lines, ',') AS lines FROM ed WHERE caller NOT LIKE 'tests/%' AND callee NOT LIKE 'tests/%'"),
    "signature_render": (False, "", f"SELECT id, {SIG} AS signature FROM sym"),
    "scalar_functions": (False, "", f"""SELECT id, dir, {STEM.format("path")} AS stem, length(id) // 4 AS tokens, trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
        list_filter(string_split(regexp_replace(id, '::|->|/', '.', 'g'), '.'), lambda x: x <> '')[-1] AS base, array_to_string(string_split(replace(path, '/', '.'), '.'), '|') AS segments,
        array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), '|') AS terms, CASE WHEN length(id) <= 20 THEN id ELSE rtrim(id[1:19]) || '…' END AS short, regexp_replace(id, '[/\\\\:]', '-', 'g') AS folder, name AS plain, name AS unquoted
        FROM (SELECT *, list_filter(list_transform(regexp_extract_all(qualname, '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2) AS t FROM sym)"""),
    "outline_file": (False, "", """SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_line, qualname, id) AS "row", repeat('  ', len(string_split(qualname, '.'))) || name || '(' || coalesce(param, '') || ')' || coalesce(' -> ' || returns, '') || '  L' || start_line || '-' || end_line AS line
        FROM sym WHERE path IN ('src/brand_2/mod_11.py', 'src/brand_17/mod_28.py')"""),
    "outline_dir": (False, "", "SELECT path, count(*) AS symbols, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path LIKE 'tests/%', path) AS position FROM sym GROUP BY path"),
    "edge_dedupe": (False, "", "SELECT caller, callee, array_to_string(lines, ',') AS lines FROM ed"),
    "adjacency_in": (False, "", "SELECT callee AS id, array_to_string(list_sort(list(DISTINCT caller)), ',') AS neighbours FROM ed GROUP BY 1"),
    "adjacency_out": (False, "", "SELECT caller AS id, array_to_string(list_sort(list(DISTINCT callee)), ',') AS neighbours FROM ed GROUP BY 1"),
    "degree": (False, "", "SELECT id, fan_in, fan_out, degree FROM deg"),
    "relevance_order": (False, "", "SELECT id, degree FROM deg ORDER BY test, degree DESC, path, start_line LIMIT 50"),
    "callers_of": (False, "", f"SELECT caller AS id, array_to_string(lines, ',') AS lines FROM ed WHERE callee = {SEVEN}"),
    "callees_of": (False, "", f"SELECT callee AS id, array_to_string(lines, ',') AS lines FROM ed WHERE caller = {SEVEN}"),
    "caller_sites": (False, "", f"SELECT caller AS id, path, unnest(lines) AS line FROM ed JOIN sym ON id = caller WHERE callee = {SEVEN}"),
    "symbol_card": (False, "", "SELECT id, kind, path, start_line, fan_in, fan_out, (SELECT count(*) FROM nt WHERE symbol_id = id) AS notes FROM deg"),
    "file_symbols": (False, "", "SELECT path, start_line, qualname, kind FROM sym WHERE path LIKE 'src/brand_1/%'"),
    "definition_order": (False, "", "SELECT id, row_number() OVER (PARTITION BY path ORDER BY start_line, qualname, id) AS position FROM sym"),
    "duplicate_ids": (False, "", "SELECT p_partkey, id FROM sym"),
    "import_first_wins": (False, "", "SELECT path, name, source FROM i1"),
    "external_uses": (False, "", "SELECT caller, callee FROM ex WHERE list_filter(string_split(regexp_replace(callee, '::|->|/', '.', 'g'), '.'), lambda x: x <> '')[-1] = 'The'"),
    "external_grouping": (False, "", "SELECT caller, callee, count(*) AS n, max(length(callee)) AS line FROM ex GROUP BY 1, 2"),
    "shadow_names": (False, "", "SELECT DISTINCT base FROM (SELECT list_filter(string_split(regexp_replace(callee, '::|->|/', '.', 'g'), '.'), lambda x: x <> '')[-1] AS base FROM ex) WHERE base IN (SELECT string_split(name, '_')[1] FROM sym) OR base IN (SELECT qualname FROM sym)"),
    "target_resolution": (False, "", "SELECT id FROM sym WHERE path LIKE '%/mod_11.py' AND (qualname = 'small_ring' OR name = 'small_ring')"),
    **{f"resolve_{r}": (w, LADDER, f'SELECT DISTINCT caller, name, line, "{r}" AS callee FROM lad WHERE "{r}" IS NOT NULL') for r, w in (("same_file", False), ("hint", False), ("only", True), ("container", True), ("typed", True))},
    "resolve_external_receiver": (True, "", "SELECT DISTINCT caller, 'ring.' || name AS text, line FROM rc WHERE receiver = 'ring' AND path IN (SELECT path FROM im WHERE ordinal = 1)"),
    "resolve_alias": (True, f"""al AS (SELECT i1.path, i1.name, i1.source, count(*) AS n, min(id) AS one FROM i1 JOIN sym ON sym.name = i1.name AND list_contains({SEGMENTS.format("i1.source")}, {STEM.format("sym.path")}) GROUP BY 1, 2, 3)""",
        "SELECT DISTINCT caller, 'al_' || rc.name AS name, line, n AS alias_n, one AS alias FROM rc JOIN al USING (path, name)"),
    "resolve_ctor_pair": (True, CLASSES, "SELECT name, id AS pair FROM cs"),
    "ctor_credit": (True, CLASSES, "SELECT 'src/a.py::f' AS caller, id AS callee, '3' AS lines FROM cs UNION ALL SELECT 'src/a.py::f', id || '.' || name, '3' FROM cs"),
    "call_graph_full": (True, LADDER, GRAPH),
    "refs_graph_full": (True, LADDER, GRAPH),
    "ambiguous_calls": (False, LADDER, "SELECT caller, w.name, len(ids) AS n, array_to_string(ids, ',') AS candidates FROM (SELECT DISTINCT caller, name FROM won WHERE target IS NULL) w JOIN (SELECT name, list(id ORDER BY test, id) AS ids FROM sym GROUP BY 1) c ON c.name = w.name"),
    "ambiguous_in": (True, LADDER, "SELECT id AS candidate, count(*) AS n FROM (SELECT DISTINCT caller, name FROM won WHERE target IS NULL) w JOIN sym ON sym.name = w.name GROUP BY 1"),
    "hotspots_fan_in": (False, "", "SELECT id, fan_in, path, start_line FROM deg WHERE fan_in > 0 ORDER BY fan_in DESC, path, start_line LIMIT 10"),
    "hotspots_fan_out": (False, "", "SELECT id, fan_out, path, start_line FROM deg WHERE fan_out > 0 ORDER BY fan_out DESC, path, start_line LIMIT 10"),
    "largest_files": (False, "", "SELECT path, count(*) AS symbols FROM sym GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "language_mix": (False, "", "SELECT language, count(*) AS files, CAST(sum(1 + doc_id % 3) AS BIGINT) AS symbols FROM fi GROUP BY 1"),
    "kind_counts": (False, "", "SELECT count(*) AS functions, 0 AS types, 0 AS variables, count(*) AS symbols FROM sym"),
    "run_summary": (False, "", "SELECT count(*) AS edges, count_if(len(lines) > 1) AS ambiguous, (SELECT count(*) FROM ex) AS external FROM ed"),
    "stats_row": (False, "", "SELECT count(*) AS functions, 0 AS types, 0 AS variables, count(*) AS symbols, count(DISTINCT path) AS files, (SELECT count(*) FROM ed) AS edges FROM sym"),
    "directory_rollup": (False, "cp AS (SELECT a.dir AS a, b.dir AS b FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee)", """SELECT dir, count(DISTINCT path) AS files, count(*) AS symbols, (SELECT count(*) FROM cp WHERE a = dir AND b = dir) AS internal,
        (SELECT count(*) FROM cp WHERE a <> b AND (a = dir OR b = dir)) AS "cross", 'Handles ' || min(path) || ' and whatever else belongs to it in the folder of its brand' AS purpose FROM sym GROUP BY dir ORDER BY symbols DESC, dir LIMIT 12"""),
    "directory_coupling": (False, "cp AS (SELECT a.dir AS a, b.dir AS b FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee)", """SELECT dir, count_if(same) AS internal, count_if(NOT same) AS "cross" FROM (SELECT a AS dir, a = b AS same FROM cp UNION ALL SELECT b, false FROM cp WHERE a <> b) GROUP BY 1"""),
    "directory_purpose": (False, "", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(doc, path) AS purpose FROM fi WHERE doc <> '' GROUP BY 1"),
    "entrypoints": (False, "", "SELECT id, path, start_line FROM deg WHERE name = 'main' OR (fan_in = 0 AND (decorated OR exported))"),
    "churn_counts": (False, CHURN, "SELECT path, commits FROM ch"),
    "churn_hotspots": (False, CHURN + ", ff AS (SELECT path, CAST(sum(fan_in) AS BIGINT) AS f FROM deg GROUP BY 1)", "SELECT ch.path, commits, f AS fan_in, round_even(commits * (f / (SELECT max(f) FROM ff)), 1) AS score FROM ch JOIN ff USING (path) WHERE f > 0 ORDER BY score DESC, path LIMIT 10"),
    "file_fan_in": (False, "", "SELECT path, CAST(sum(fan_in) AS BIGINT) AS fan_in FROM deg GROUP BY 1"),
    "unused_symbols": (False, "us AS (SELECT DISTINCT path, unnest([string_split(qualname, '.')[1], qualname]) AS qualname FROM deg WHERE fan_in > 0)", """SELECT id, path, start_line FROM deg WHERE NOT (decorated OR exported OR test OR path LIKE 'src/brand_3/%')
        AND NOT EXISTS (SELECT 1 FROM us WHERE us.path = deg.path AND us.qualname = deg.qualname)"""),
    "reexports": (False, "", "SELECT DISTINCT name FROM im WHERE path LIKE '%mod_1.py%'"),
    "used_key_closure": (False, "", "SELECT DISTINCT path, unnest([string_split(qualname, '.')[1], qualname]) AS qualname FROM deg WHERE fan_in > 0"),
    "skip_reasons": (False, VERDICTS, "SELECT verdict AS reason, count(*) AS files FROM fv WHERE verdict <> 'ok' GROUP BY 1"),
    "symbol_diff": (False, DIFF, "SELECT id, change, path, qualname FROM df WHERE change IS NOT NULL"),
    "freshness_diff": (False, "nw AS (SELECT path, CASE WHEN doc_id % 19 = 0 THEN 'changed' ELSE content_hash END AS h FROM fi WHERE doc_id % 17 <> 0 UNION ALL SELECT 'new/' || path, content_hash FROM fi WHERE doc_id % 101 = 0)", """SELECT coalesce(fi.path, nw.path) AS path,
        CASE WHEN fi.path IS NULL THEN 'added' WHEN nw.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM fi FULL JOIN nw ON fi.path = nw.path WHERE fi.path IS NULL OR nw.path IS NULL OR content_hash <> h"""),
    "cache_misses": (False, "", "SELECT path, content_hash FROM fi WHERE doc_id % 19 = 0"),
    "impacted_tests": (False, DIFF + ", dl AS (SELECT * FROM df WHERE change IS NOT NULL), " + hops("SELECT id FROM dl WHERE change <> 'removed'") + f""",
        im2 AS (SELECT DISTINCT path FROM im WHERE path LIKE 'tests/%' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT {STEM.format("path")} AS stem FROM dl) WHERE list_contains({SEGMENTS.format("source")}, stem))),
        ci AS (SELECT path, CASE WHEN min(hop) <= 1 THEN 'direct' ELSE 'transitive' END AS tier, count(*) AS symbols FROM walk JOIN sym USING (id) WHERE test GROUP BY 1)""",
        "SELECT path, tier, symbols FROM ci UNION ALL SELECT path, 'import', 0 FROM im2 WHERE path NOT IN (SELECT path FROM ci)"),
    "impacted_import_tier": (False, "", f"""SELECT DISTINCT path FROM im WHERE path LIKE 'tests/%' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT {STEM.format("path")} AS stem FROM sym WHERE path LIKE 'src/brand_2/%') WHERE list_contains({SEGMENTS.format("source")}, stem))"""),
    "symbol_impact": (False, hops(SEVEN[1:-1]), "SELECT path, CASE WHEN min(hop) <= 1 THEN 'direct' ELSE 'transitive' END AS tier FROM walk JOIN sym USING (id) WHERE test GROUP BY 1"),
    "reverse_reach": (False, hops(SEVEN[1:-1]), "SELECT id, hop FROM walk"),
    "neighbourhood_2hop": (False, f"""st AS (SELECT callee AS a, caller AS b, 0 AS d FROM ed UNION ALL SELECT caller, callee, 1 FROM ed),
        h1 AS (SELECT b AS id, min(d) AS d FROM st WHERE a = {SEVEN} AND b <> {SEVEN} GROUP BY 1),
        h2 AS (SELECT b AS id, min(st.d) AS d FROM h1 JOIN st ON a = id WHERE b <> {SEVEN} AND b NOT IN (SELECT id FROM h1) GROUP BY 1)""", "SELECT id, 1 AS hop, CASE d WHEN 0 THEN 'caller' ELSE 'callee' END AS direction FROM h1 UNION ALL SELECT id, 2, CASE d WHEN 0 THEN 'caller' ELSE 'callee' END FROM h2"),
    "file_neighbourhood": (False, "", "SELECT DISTINCT caller AS id FROM ed JOIN sym ON id = callee WHERE path = 'src/brand_2/mod_11.py' AND caller NOT IN (SELECT id FROM sym WHERE path = 'src/brand_2/mod_11.py')"),
    "file_graph": (False, "", "SELECT DISTINCT a.path AS src, b.path AS dst FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee WHERE a.path <> b.path"),
    "dir_graph": (False, "", "SELECT DISTINCT a.dir AS src, b.dir AS dst FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee WHERE a.dir <> b.dir"),
    "symbol_graph": (False, "", "SELECT caller AS src, callee AS dst FROM ed"),
    **{f"{style}_lines": (False, "dg AS (SELECT DISTINCT a.dir AS src, b.dir AS dst FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee WHERE a.dir <> b.dir), nn AS (SELECT name, 'n' || (row_number() OVER (ORDER BY name) - 1) AS n FROM (SELECT src AS name FROM dg UNION SELECT dst FROM dg))",
        f"SELECT n || {a} || name || {b} AS line FROM nn UNION ALL SELECT x.n || {c} || y.n || {e} FROM dg JOIN nn x ON x.name = src JOIN nn y ON y.name = dst") for style, a, b, c, e in (("mermaid", "'[\"'", "'\"]'", "' --> '", "''"), ("dot", "' [label=\"'", "'\"];'", "' -> '", "';'"))},
    "module_edges": (False, "", "SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ', ') AS targets FROM (SELECT a.dir AS src, b.dir AS dst FROM ed JOIN sym a ON a.id = caller JOIN sym b ON b.id = callee WHERE a.dir <> b.dir) GROUP BY 1"),
    "trace_path_lengths": (False, f"""fw(id, hop) USING KEY (id) AS (SELECT id, 0 FROM {SEVEN} UNION SELECT DISTINCT callee, fw.hop + 1 FROM fw JOIN ed ON caller = fw.id WHERE NOT EXISTS (SELECT 1 FROM recurring.fw r WHERE r.id = ed.callee)),
        pt(id, hop, n) AS (SELECT id, 0, 1 FROM {SEVEN} UNION ALL SELECT f2.id, f2.hop, sum(pt.n) FROM pt JOIN ed ON caller = pt.id JOIN fw f2 ON f2.id = callee AND f2.hop = pt.hop + 1 GROUP BY 1, 2)""",
        "SELECT hop AS length, CAST(sum(n) AS BIGINT) AS paths FROM pt WHERE id = (SELECT id FROM sym WHERE p_partkey = 11) GROUP BY 1"),
    "budget_fit_callers": (False, FIT.format(prefix=12), "SELECT id, rank, cost FROM kp"),
    "budget_fit_files": (False, "ff AS (SELECT id, path, row_number() OVER w AS rank, (sum(length(id) + 1) OVER w - 1) // 4 AS cost FROM sym WINDOW w AS (PARTITION BY path ORDER BY start_line ROWS UNBOUNDED PRECEDING))", "SELECT id, path, rank, cost FROM ff WHERE cost <= 20 OR rank = 1"),
    "meter_row": (False, FIT.format(prefix=-1), "SELECT max(cost) AS tokens, count(*) AS returned, (SELECT count(*) FROM cl) AS total, (SELECT count(*) FROM cl) - count(*) AS omitted, CASE WHEN count(*) >= (SELECT count(*) FROM cl) THEN NULL WHEN count(*) >= 50 THEN 'limit' ELSE 'budget' END AS truncated_by, round_even(max(cost) / greatest(count(*), 1), 1) AS per_signal FROM kp"),
    "group_caps": (False, "", "SELECT id, rank, more FROM (SELECT id, row_number() OVER (PARTITION BY path ORDER BY start_line) AS rank, greatest(count(*) OVER (PARTITION BY path) - 3, 0) AS more FROM sym) WHERE rank <= 3"),
    "relevance_scores": (False, LEX, "SELECT id, raw2 + CASE path WHEN 'src/brand_2/mod_11.py' THEN 4 WHEN 'src/brand_4/mod_5.py' THEN 2 ELSE 0 END AS raw2 FROM lx"),
    "blended_rank": (False, LEX, "SELECT id, round(0.5 * raw2 / (SELECT max(raw2) FROM lx) + 0.5 * (fan_in - (SELECT min(fan_in) FROM lx)) / (SELECT max(fan_in) - min(fan_in) FROM lx), 6) AS blend FROM lx"),
    "lean_atoms": (False, CHURN, f"SELECT id, name, {SIG} AS signature, round(fan_in * (1 + coalesce(commits, 0) / (SELECT max(commits) FROM ch)), 6) AS score, test AS demotable FROM deg LEFT JOIN ch ON ch.path = deg.path"),
    "lean_ladder_cut": (False, f"""ato AS (SELECT id, fan_in, (length({SIG}) + 1) // 4 AS s, (length(name) + 1) // 4 AS n FROM deg),
        cu AS (SELECT *, coalesce(sum(s - n) OVER w, 0) AS ss, coalesce(sum(n) OVER w, 0) AS sn, sum(s) OVER () AS alls, sum(n) OVER () AS alln FROM ato WINDOW w AS (ORDER BY fan_in, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "SELECT id, CASE WHEN alls - ss <= 3000 THEN 'sig' WHEN alln <= 3000 OR alln - sn <= 3000 THEN 'name' ELSE 'none' END AS form FROM cu"),
    "lean_dense": (False, "", "SELECT id, CASE WHEN row_number() OVER (ORDER BY fan_in DESC, id) <= 30 THEN 'sig' ELSE 'name' END AS form FROM deg"),
    "lean_cap": (False, "", "SELECT count(DISTINCT path) AS files, least(12000, 3000 + 12 * count(DISTINCT path)) AS cap FROM sym"),
    "lean_backbone": (False, "", "SELECT dir, count(DISTINCT path) AS files, count(*) AS symbols, bool_and(test) AS demotable FROM sym GROUP BY 1"),
    "touched_file_rank": (False, DIFF, "SELECT deg.path, CAST(sum(degree) AS BIGINT) AS degree FROM deg JOIN df USING (id) WHERE change IN ('added', 'changed') GROUP BY 1"),
    "workset_rows": (False, "td AS (SELECT id, path FROM sym WHERE p_partkey IN (7, 11, 13)), " + hops("SELECT id FROM td"), """SELECT 0 AS tier, count(DISTINCT path) AS rows FROM td HAVING count(*) > 0 UNION ALL
        SELECT 1, count(DISTINCT item) FROM (SELECT caller AS item FROM ed WHERE callee IN (SELECT id FROM td) UNION ALL SELECT callee FROM ed WHERE caller IN (SELECT id FROM td)) HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM td HAVING count(*) > 0 UNION ALL SELECT 3, count(DISTINCT sym.path) FROM walk JOIN sym USING (id) WHERE test HAVING count(*) > 0"""),
    "notes_attach": (False, "", "SELECT id, text FROM sym JOIN nt ON symbol_id = id"),
    "notes_orphaned": (False, "", "SELECT symbol_id, text FROM nt WHERE symbol_id LIKE 'gone::%'"),
    "ledger_sessions": (False, SESSIONS, "SELECT session_id, turns, consumed FROM ss"),
    "ledger_files": (False, READ_FILES, "SELECT rf.session_id, rf.path, fully_read, count(id) AS symbols FROM rf LEFT JOIN seen ON seen.session_id = rf.session_id AND seen.path = rf.path GROUP BY 1, 2, 3"),
    "ledger_read_range": (False, "", "SELECT session_id, id FROM seen"),
    "ledger_budget": (False, SESSIONS, "SELECT session_id, greatest(200000 - consumed, 20000) AS left, greatest(1, least(5, 5 * greatest(200000 - consumed, 20000) // 180000)) AS k FROM ss"),
    "churn_tumbling": (False, "", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, path, count(*) AS commits FROM cm GROUP BY 1, 2"),
    "churn_session": (False, "gp AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS n FROM cm), gq AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM gp)", "SELECT min(ts) AS start, path, count(*) AS commits FROM gq GROUP BY path, g"),
    "trace_all_shortest": (False, f"""fw(id, hop) USING KEY (id) AS (SELECT id, 0 FROM {SEVEN} UNION SELECT DISTINCT callee, fw.hop + 1 FROM fw JOIN ed ON caller = fw.id WHERE NOT EXISTS (SELECT 1 FROM recurring.fw r WHERE r.id = ed.callee)),
        pt(id, hop, path) AS (SELECT id, 0, id FROM {SEVEN} UNION ALL SELECT f2.id, f2.hop, pt.path || '>' || f2.id FROM pt JOIN ed ON caller = pt.id JOIN fw f2 ON f2.id = callee AND f2.hop = pt.hop + 1)""",
        "SELECT hop AS length, path FROM pt WHERE id = (SELECT id FROM sym WHERE p_partkey = 11)"),
    "external_calls": (True, LADDER.replace("FROM rc LEFT JOIN cand", "FROM r7 rc LEFT JOIN cand").replace("cand AS (", "r7 AS (SELECT * REPLACE (CASE WHEN line % 7 = 0 THEN 'outside' ELSE name END AS name), coalesce(receiver || '.', '') || name AS text FROM rc),\ncand AS (", 1),
        "SELECT caller, text AS callee, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM won WHERE n_candidates = 0 GROUP BY 1, 2"),
    "ambiguous_owners": (True, LADDER, "SELECT caller, w.name, id AS candidate FROM (SELECT DISTINCT caller, name FROM won WHERE target IS NULL) w JOIN sym ON sym.name = w.name"),
    "task_files": (False, """tk AS (SELECT path, list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(path || coalesce(' ' || doc, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z][A-Z])([0-9])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))) AS terms FROM fi)""",
        "SELECT path, CAST(sum(CASE WHEN list_contains(terms, t) THEN 2 WHEN length(t) >= 3 AND len(list_filter(terms, lambda x: contains(x, t))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS raw2 FROM tk, (SELECT unnest(['src1', 'fr']) AS t) GROUP BY 1 HAVING raw2 > 0 ORDER BY raw2 DESC, path LIMIT 5"),
    "custom_scorer": (False, "", "SELECT id, raw, round(CASE WHEN top > 0 THEN raw / top ELSE 0 END, 6) AS score FROM (SELECT id, length(qualname) - length(path) AS raw, max(length(qualname) - length(path)) OVER () AS top FROM sym)"),
    "adaptive_pointer": (False, READ_FILES + """, nm AS (SELECT path, path || ' ' || string_agg(DISTINCT name, ' ') AS text FROM sym WHERE path NOT IN (SELECT path FROM rf WHERE session_id = 1 AND fully_read) GROUP BY 1),
        tk AS (SELECT path, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS terms FROM nm)""",
        "SELECT path, CAST(sum(CASE WHEN list_contains(terms, t) THEN 2 WHEN length(t) >= 3 AND len(list_filter(terms, lambda x: contains(x, t))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS raw2 FROM tk, (SELECT unnest(['red', 'widget', '17']) AS t) GROUP BY 1 HAVING raw2 > 0 ORDER BY raw2 DESC, path LIMIT 5"),
    "ledger_totals": (False, SESSIONS + ", " + READ_FILES + ", rs AS (SELECT rf.session_id, count(DISTINCT rf.path) AS files, count(DISTINCT CASE WHEN fully_read THEN rf.path END) AS whole, count(id) AS symbols FROM rf LEFT JOIN seen ON seen.session_id = rf.session_id AND seen.path = rf.path GROUP BY 1)",
        "SELECT ss.*, coalesce(files, 0) AS files, coalesce(whole, 0) AS files_whole, coalesce(symbols, 0) AS symbols FROM ss LEFT JOIN rs USING (session_id)"),
    "ledger_top_files": (False, READ_FILES, "SELECT session_id, path, fully_read, symbols FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY symbols DESC, path) AS n FROM (SELECT rf.session_id, rf.path, fully_read, count(id) AS symbols FROM rf LEFT JOIN seen ON seen.session_id = rf.session_id AND seen.path = rf.path GROUP BY 1, 2, 3)) WHERE n <= 2"),
    "pytest_hint": (False, hops(SEVEN[1:-1]) + ", hi AS (SELECT path, CASE WHEN min(hop) <= 1 THEN 0 ELSE 1 END AS t FROM walk JOIN sym USING (id) WHERE test GROUP BY 1)",
        "SELECT 'pytest ' || array_to_string(list(path ORDER BY t, path)[1:20], ' ') || CASE WHEN count(*) > 20 THEN '  # +' || (count(*) - 20) || ' more impacted test files not shown' ELSE '' END AS hint FROM hi HAVING count(*) > 0"),
    "symbol_diff_callers": (False, DIFF, "SELECT df.id, change, coalesce((SELECT string_agg(caller, ',' ORDER BY caller) FROM me WHERE callee = df.id AND change <> 'removed'), (SELECT string_agg(caller, ',' ORDER BY caller) FROM ed WHERE callee = df.id AND change = 'removed'), '') AS callers FROM df WHERE change IS NOT NULL"),
    "diff_lines": (False, DIFF + """, dc AS (SELECT *, CASE WHEN change = 'removed' THEN (SELECT list(caller ORDER BY caller) FROM ed WHERE callee = df.id) ELSE (SELECT list(caller ORDER BY caller) FROM me WHERE callee = df.id) END AS callers,
        row_number() OVER (PARTITION BY change ORDER BY path, qualname, id) AS "rank", count(*) OVER (PARTITION BY change) AS n FROM df WHERE change IS NOT NULL)""",
        """SELECT change, "rank", CASE change WHEN 'added' THEN '+ ' WHEN 'removed' THEN '- ' ELSE '~ ' END || id || CASE WHEN len(callers) > 0 THEN '  <- ' || array_to_string(callers[1:3], ', ') || CASE WHEN len(callers) > 3 THEN ', +' || (len(callers) - 3) ELSE '' END ELSE '' END AS line, greatest(n - 8, 0) AS more FROM dc WHERE "rank" <= 8"""),
    "zero_fan_types": (False, "e1 AS (SELECT * FROM ed WHERE len(lines) > 1)", "SELECT id FROM sym WHERE decorated AND id NOT IN (SELECT callee FROM e1) AND id NOT IN (SELECT caller FROM e1) AND id NOT IN (SELECT caller FROM me)"),
    "referenced_fallback": (False, "", "SELECT me.callee AS id, me.caller, coalesce(sym.path, replace(me.caller, '::<module>', '')) AS path, sym.start_line AS line FROM me LEFT JOIN sym ON sym.id = me.caller WHERE me.callee NOT IN (SELECT callee FROM ed WHERE len(lines) > 1)"),
    "minor_files": (False, "", "SELECT path, language FROM fi WHERE (language IN ('en', 'fr') OR coalesce(doc, '') = '') AND size <= 2000"),
    "unique_anchors": (False, "an AS (SELECT p_partkey, trim(regexp_replace(lower(kind || ' ' || name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM sym)", "SELECT p_partkey, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM an)"),
    "section_order": (False, "", """SELECT path, row_number() OVER (ORDER BY regexp_replace(path, '/[^/]*$', ''), f DESC, path) AS "rank" FROM (SELECT path, sum(fan_in) AS f FROM deg GROUP BY 1)"""),
    "size_advice": (False, "ol AS (SELECT path, (2 * len(string_split(qualname, '.')) + length(name || '(' || coalesce(param, '') || ')' || coalesce(' -> ' || returns, '') || '  L' || start_line || '-' || end_line)) // 4 AS t FROM sym)", "SELECT path, count(*) * 400 AS full, CAST(sum(t) AS BIGINT) AS outline, CAST(round_even(100 * sum(t) / (count(*) * 400), 0) AS INTEGER) AS percent FROM ol GROUP BY 1 HAVING count(*) * 400 >= 800"),
    "sparse_outlines": (False, "ol AS (SELECT path, p_partkey, (2 * len(string_split(qualname, '.')) + length(name || '(' || coalesce(param, '') || ')' || coalesce(' -> ' || returns, '') || '  L' || start_line || '-' || end_line)) // 4 AS t FROM sym)",
        "SELECT * FROM (SELECT path, CAST(sum(t) AS BIGINT) AS outline, count(*) AS symbols, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 2000 ELSE 20 END) AS BIGINT) AS \"full\" FROM ol GROUP BY 1) WHERE \"full\" >= 500 AND symbols <= 8 AND outline <= 0.15 * \"full\""),
    "json_budget": (False, MANY + """, js AS (SELECT id, row_number() OVER w AS "rank", '{"id": "' || id || '", "kind": "' || kind || '", "path": "' || path || '", "start_line": ' || start_line || ', "test": ' || test || '}' AS entry FROM (SELECT * FROM cl ORDER BY test, degree DESC, path, start_line LIMIT 50) WINDOW w AS (ORDER BY test, degree DESC, path, start_line)),
        jc AS (SELECT *, (sum(length(entry) + 1) OVER (ORDER BY "rank") - 1) // 4 AS cost FROM js)""", """SELECT id, "rank", cost, entry FROM jc WHERE cost <= 300 OR "rank" = 1"""),
    "budget_all": (False, "", """SELECT id, row_number() OVER w AS "rank", (sum(length(id) + 1) OVER w - 1) // 4 AS cost FROM deg WINDOW w AS (ORDER BY test, degree DESC, path, start_line, id ROWS UNBOUNDED PRECEDING)"""),
    "pack_neighbours": (False, packs(None), "SELECT target, id, CASE d WHEN 0 THEN 'caller' ELSE 'callee' END AS direction, path, line, sig AS signature, degree FROM en"),
    "call_site_excerpts": (False, "", "SELECT callee AS target, caller AS id, x AS line, 'line ' || x AS text FROM me, unnest(lines[1:3]) AS u(x)"),
    "pack_whole": (False, packs(None, notes=True), PACK_TEXT),
    "pack_trim": (False, packs(90), PACK_TEXT),
    "pack_trim_source": (False, packs(60, source=True), PACK_TEXT),
    "pack_trim_task": (False, packs(90, scores=True), "SELECT target, CASE sec WHEN 4 THEN 'callers' ELSE 'callees' END AS section, pos AS position, text AS line FROM ch2 WHERE sec IN (4, 5) AND pos > 0"),
    "lean_report": (False, lean("NULL", False, "false"), "SELECT cap, NOT m AS mermaid_dropped, folded AS demotable_collapsed, nosig AS signatures_dropped, noname AS names_dropped, NOT linked AS module_edges_dropped, width AS purpose_width, width = 0 AS floored, CASE WHEN folded THEN prod ELSE files END + shown AS signals, known AS already_seen FROM kc"),
    "lean_lines": (False, lean("NULL", False, "false"), LEAN_LINES + " " + LEAN_EDGES),
    "lean_lines_dense": (False, lean("10000000", True, "decorated"), LEAN_LINES),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {symbols(fine)}{',' if more else ''} {more} {body}" for name, (fine, more, body) in BODIES.items()}
