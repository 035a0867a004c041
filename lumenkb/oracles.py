"""SQL for the queries of ``catalog``, for an independent engine over the same tables."""

from __future__ import annotations

ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
NOW = 1_717_200_000


def words(x: str) -> str:
    return rf"regexp_extract_all(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def estimate(x: str) -> str:
    solid = rf"regexp_replace({x}, '\s', '', 'g')"
    other = rf"length(regexp_replace({solid}, '[一-鿿㐀-䶿豈-﫿]', '', 'g'))"
    return f"CAST(ceil({other} / 4.0) + ceil((length({solid}) - {other}) * 2 / 3.0) AS BIGINT)"


def n_lines(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split(regexp_replace({x}, '\\n$', ''), chr(10))) END)"


NOTES = f"""
notes AS (
  SELECT d.doc_id, concat(source, '/', lang, '/', CAST(d.doc_id AS VARCHAR), '.md') AS path, string_split(text, chr(10))[1] AS title, concat(lang, ' ', source) AS tags,
    ['L0Ephemeral', 'L1Resource', 'L2Log', 'L3Evergreen'][CAST(d.doc_id % 4 + 1 AS INTEGER)] AS level,
    {NOW} - d.doc_id % 730 * 86400 AS mtime,
    CASE WHEN toxic = 1 THEN 'superseded' WHEN quality = 0 THEN 'deprecated' ELSE 'active' END AS status, text AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

ACCESS = """
ev AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
seq AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM ev),
walk AS (
  SELECT user_id, event_type, i, CAST(1 AS BIGINT) AS n, ts AS last FROM seq WHERE i = 1
  UNION ALL
  SELECT s.user_id, s.event_type, s.i, CASE WHEN s.ts - w.last >= 60 THEN w.n + 1 ELSE w.n END, CASE WHEN s.ts - w.last >= 60 THEN s.ts ELSE w.last END
  FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.event_type = w.event_type AND s.i = w.i + 1
),
access AS (SELECT user_id, event_type, max(n) AS access_count, max(last) AS last_access FROM walk GROUP BY ALL)"""


def reinforce(count: str, last: str) -> str:
    age = f"greatest(({NOW} - {last}) / 86400.0, 0)"
    return f"least(1.15, greatest(1.0, 1 + 0.15 * least(1.0, log2(1 + {count}) / 4) * power(2.0, -{age} / 30.0)))"


def decayed(stale: str) -> str:
    age = f"greatest(({NOW} - mtime) / 86400.0, 0)"
    factor = f"CASE level WHEN 'L0Ephemeral' THEN 0.5 + 0.5 * power(2.0, -{age} / 60.0) WHEN 'L2Log' THEN 0.7 + 0.3 * power(2.0, -{age} / 180.0) ELSE 1.0 END"
    return f"(CASE WHEN mtime >= 946684800 AND mtime <= {NOW} + 86400 THEN {factor} ELSE 1.0 END) * (CASE WHEN {stale} THEN 0.45 ELSE 1.0 END)"


#: Query terms: the eight longest distinct tokens of each item.
TERMS = f"""
qt AS (SELECT item_id AS query_id, unnest({words("text")}) AS term, generate_subscripts({words("text")}, 1) AS pos FROM benchmark),
qd AS (SELECT query_id, term, min(pos) AS pos FROM qt GROUP BY ALL),
qterms AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, pos) AS n FROM qd) WHERE n <= 8)"""


def bm25(src: str, p: str) -> str:
    """CTEs that end in ``{p}bm25``: query_id, doc_id, score."""
    return f"""
{p}tok AS (SELECT doc_id, unnest({words("body")}) AS term FROM {src}),
{p}post AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}len AS (SELECT doc_id, len({words("body")}) AS n FROM {src}),
{p}stat AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM {p}len),
{p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}bm25 AS (
  SELECT q.query_id, p.doc_id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
  FROM qterms q JOIN {p}post p USING (term) JOIN {p}df USING (term) JOIN {p}len USING (doc_id), {p}stat GROUP BY ALL
)"""


#: Phrases by tier: 0 every part between white space, 2 the eight that are best. Without CJK text tier 1 asks for what tier 0 asks for.
PHRASES = rf"""
uraw AS (SELECT item_id AS query_id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (SELECT item_id, string_split_regex(trim(text), '\s+') AS s FROM benchmark)),
un AS (SELECT query_id, pos, array_to_string({words("raw")}, ' ') AS term, regexp_replace(lower(raw), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS k FROM uraw),
u2d AS (SELECT query_id, k, min(pos) AS pos, arg_min(term, pos) AS term FROM un WHERE term <> '' GROUP BY 1, 2),
u2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(k) < 3, length(k) DESC, pos) AS n FROM u2d),
units AS (SELECT query_id, 0 AS t, term, count(*) AS times FROM un WHERE term <> '' GROUP BY ALL UNION ALL SELECT query_id, 2, term, count(*) FROM u2 WHERE n <= 8 GROUP BY ALL),
need AS (SELECT query_id, t, CASE WHEN t = 0 THEN count(*) ELSE 1 END AS need FROM units GROUP BY query_id, t),
phrases AS (SELECT term, string_split(term, ' ') AS ph FROM (SELECT DISTINCT term FROM units))"""


def laddered(src: str, p: str) -> str:
    """CTEs that end in ``{p}bm25``: query_id, doc_id, t, score, f (the tier's weight), of the first tier with hits."""
    return f"""
{p}w AS (SELECT doc_id, w, len(w) - 2 AS n FROM (SELECT doc_id, list_concat({words("title")}, [''], {words("body")}, [''], {words("tags")}) AS w FROM {src})),
{p}tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {p}w),
{p}post AS (
  SELECT doc_id, term, count(*) AS tf FROM {p}tok JOIN phrases ON word = ph[1] AND len(ph) = 1 GROUP BY ALL
  UNION ALL SELECT t.doc_id, term, count(*) FROM {p}tok t JOIN phrases ON word = ph[1] AND len(ph) > 1 JOIN {p}w x ON x.doc_id = t.doc_id WHERE x.w[t.pos : t.pos + len(ph) - 1] = ph GROUP BY ALL
),
{p}stat AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM {p}w),
{p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}sc AS (
  SELECT u.query_id, u.t, p.doc_id, count(*) AS m, sum(times * greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
  FROM units u JOIN {p}post p USING (term) JOIN {p}df USING (term) JOIN {p}w USING (doc_id), {p}stat GROUP BY ALL
),
{p}hit AS (SELECT s.*, min(s.t) OVER (PARTITION BY query_id) AS first FROM {p}sc s JOIN need n USING (query_id, t) WHERE m >= need),
{p}bm25 AS (SELECT query_id, doc_id, t, score, CASE WHEN t = 2 THEN 0.55 ELSE 1.0 END AS f FROM {p}hit WHERE t = first)"""


def pure(src: str, p: str) -> str:
    return f"""
{p}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM {p}bm25),
{p}s AS (SELECT query_id, b.doc_id, r, f / (60 + r) * CASE WHEN status = 'active' THEN 1.0 ELSE 0.2 END AS s FROM {p}r b JOIN {src} n ON b.doc_id = n.doc_id WHERE r <= 30),
{p}f AS (SELECT query_id AS item_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r, doc_id) AS "rank", round(s, 6) AS score FROM {p}s)"""


VECTORS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vd AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, 1 - list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS distance
  FROM v q JOIN benchmark ON q.vec_id = item_id, v c
),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS r FROM vd)"""

FUSED = """
lex AS (SELECT query_id, doc_id, f, r AS bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm25) WHERE r <= 30),
fu AS (SELECT query_id, doc_id, f, bm25_rank, r AS vector_rank FROM lex FULL JOIN (SELECT * FROM vr WHERE r <= 30) USING (query_id, doc_id)),
fw AS (SELECT *, max(bm25_rank) OVER (PARTITION BY query_id) IS NOT NULL AS l, max(vector_rank) OVER (PARTITION BY query_id) IS NOT NULL AS v FROM fu),
fused AS (
  SELECT query_id, doc_id, bm25_rank, vector_rank,
    coalesce((CASE WHEN l AND v THEN 0.5 WHEN l THEN 1.0 ELSE 0.0 END) * f / (60 + bm25_rank), 0.0) + coalesce((CASE WHEN l AND v THEN 0.5 WHEN v THEN 1.0 ELSE 0.0 END) / (60 + vector_rank), 0.0) AS score
  FROM fw
)"""

LINKS = r"""
pg AS (
  SELECT page_id AS id, html, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang FROM pages
),
pn AS (SELECT id, title, concat(lang, '/', lower(regexp_extract(title, '([\p{L}\p{N}]+)', 1))) AS p, trim(title) AS t, lang AS dir FROM pg),
raw AS (SELECT page_id AS src, unnest(l) AS raw_target, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="/?([^"]*)"', 1) AS l FROM pages)),
bare AS (SELECT *, trim(regexp_replace(trim(raw_target), '[#^].*$', '')) AS bare FROM raw),
tgt AS (SELECT b.*, regexp_replace(regexp_replace(lower(translate(bare, '\', '/')), '^(\./|/)+', ''), '\.md$', '') AS target, coalesce(n.dir, '') AS src_dir FROM bare b LEFT JOIN pn n ON n.id = b.src),
knd AS (
  SELECT *, CASE WHEN trim(raw_target) = '' THEN 'broken' WHEN bare = '' THEN 'self' WHEN target = '' THEN 'broken'
    WHEN regexp_extract(target, '\.([a-z0-9]+)$', 1) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg', 'pdf', 'canvas', 'excalidraw', 'mp4', 'webm', 'mp3', 'wav', 'zip', 'csv') THEN 'asset' END AS kind FROM tgt
),
cand AS (
  SELECT src, pos, src_dir, 1 AS tier, n.* FROM knd JOIN pn n ON target = n.p WHERE kind IS NULL
  UNION ALL SELECT src, pos, src_dir, 2, n.* FROM knd JOIN pn n ON concat(src_dir, '/', target) = n.p WHERE kind IS NULL
  UNION ALL SELECT src, pos, src_dir, 4, n.* FROM knd JOIN pn n ON NOT contains(target, '/') AND target = regexp_replace(n.p, '^.*/', '') WHERE kind IS NULL
  UNION ALL SELECT src, pos, src_dir, 5, n.* FROM knd JOIN pn n ON n.t <> '' AND lower(trim(bare)) = n.t WHERE kind IS NULL
),
best AS (SELECT src, pos, id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY src, pos ORDER BY tier, dir <> src_dir, strlen(p), p, id) AS n FROM cand) WHERE n = 1),
res AS (
  SELECT k.src, k.pos, raw_target, coalesce(kind, CASE WHEN dst = k.src THEN 'self' WHEN dst IS NOT NULL THEN 'document' ELSE 'broken' END) AS resolution, dst
  FROM knd k LEFT JOIN best b ON k.src = b.src AND k.pos = b.pos
),
edges AS (SELECT DISTINCT src, dst FROM res WHERE resolution = 'document'),
gn AS (SELECT id, p, title, ['L0Ephemeral', 'L1Resource', 'L2Log', 'L3Evergreen'][CAST(id % 4 + 1 AS INTEGER)] AS level, CASE WHEN id % 10 = 9 THEN 'superseded' ELSE 'active' END AS status FROM pn)"""

#: The scored pool f2 of the hybrid search, and ex, what its best ten active hits lead to outside of it.
HYBRID = f"""{ACCESS}, {NOTES}, {PHRASES}, {laddered("notes", "")}, {VECTORS}, {FUSED}, {LINKS},
us AS (SELECT user_id AS doc_id, sum(access_count) AS c, max(last_access) AS l FROM access GROUP BY 1),
f0 AS (SELECT fused.*, level, mtime, status, c, l, max(score) OVER (PARTITION BY query_id) AS top FROM fused JOIN notes USING (doc_id) LEFT JOIN us USING (doc_id)),
live AS (SELECT query_id, doc_id FROM f0 WHERE status = 'active'),
bo AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
lk AS (SELECT DISTINCT x.query_id, x.doc_id, true AS linked FROM live x JOIN bo ON a = x.doc_id AND a <> b JOIN live y ON y.query_id = x.query_id AND y.doc_id = b),
f1 AS (SELECT f0.*, CASE WHEN linked THEN 0.25 * top ELSE 0.0 END AS boost FROM f0 LEFT JOIN lk USING (query_id, doc_id)),
f2 AS (SELECT *, (score + boost) * {decayed("false")} * coalesce({reinforce("c", "l")}, 1.0) * CASE WHEN status = 'active' THEN 1.0 ELSE 0.2 END AS fin FROM f1),
par AS (SELECT query_id, doc_id, fin FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fin, 9) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, doc_id) AS r FROM f2 WHERE status = 'active') WHERE r <= 10),
ec AS (SELECT query_id, dst AS id, src AS parent, fin * 0.5 AS s, false AS inward FROM edges JOIN par ON doc_id = src UNION ALL SELECT query_id, src, dst, fin * 0.35, true FROM edges JOIN par ON doc_id = dst),
ee AS (
  SELECT ec.*, mtime, level, c, l, row_number() OVER (PARTITION BY query_id, id ORDER BY round(s, 12) DESC, parent) AS n FROM ec JOIN notes ON notes.doc_id = id LEFT JOIN us ON us.doc_id = id
  WHERE status = 'active' AND level <> 'L0Ephemeral' AND (NOT inward OR level = 'L3Evergreen') AND NOT EXISTS (SELECT 1 FROM f2 WHERE f2.query_id = ec.query_id AND f2.doc_id = ec.id)
),
es AS (SELECT query_id, id, parent, s * {decayed("false")} * coalesce({reinforce("c", "l")}, 1.0) AS fin FROM ee WHERE n = 1),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fin, 9) DESC, id) AS r FROM es) WHERE r <= 5)"""

SETS = f"""
sets AS (SELECT doc_id, list_sort(list_distinct({words("text")})) AS w FROM documents),
nodes AS (SELECT w, min(doc_id) AS low FROM sets WHERE len(w) > 0 GROUP BY w)"""

RULED = r"""
lines AS (SELECT doc_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, path, string_split(body, chr(10)) AS l FROM notes)),
bad AS (
  SELECT 'R1' AS rule_id, doc_id, line_no, 'deny' AS severity FROM lines WHERE regexp_matches(line, '\bpassword\b')
  UNION ALL SELECT 'R2', doc_id, line_no, 'warn' FROM lines WHERE regexp_matches(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+')
),
lack AS (SELECT 'R3' AS rule_id, doc_id, 'warn' AS severity FROM notes WHERE regexp_matches(path, '^(.*/)?src1[^/]*/(.*/)?[^/]*$|^(.*/)?src1[^/]*/.*$') AND NOT regexp_matches(body, '\bthe\b'))"""

TURNS = f"""
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
tiers AS (
  SELECT conv_id, turn, text, {n_lines("text")} AS nl, {estimate("text")} AS raw_tokens,
    CASE WHEN role IN ('system', 'user') THEN 0 WHEN pos > n - 2 THEN 1
      WHEN role = 'assistant' AND ({n_lines("text")} > 20 OR {estimate("text")} > 150) THEN 2 ELSE -1 END AS tier
  FROM t
),
folded AS (
  SELECT conv_id, turn, tier, raw_tokens,
    CASE WHEN tier = 2 THEN {estimate("concat('[Offloaded output: node_', substr(md5(text), 1, 8), ' | ', CAST(nl AS VARCHAR), ' lines]')")} ELSE raw_tokens END AS tokens
  FROM tiers
)"""

MUTATED = r"""
was AS (SELECT path, doc_id, body, md5(body) AS h, mtime FROM notes WHERE doc_id % 10 <> 1),
isb AS (SELECT path, doc_id, CASE WHEN doc_id % 10 = 3 THEN concat(body, chr(10), 'A line more.') ELSE body END AS body, mtime + CASE WHEN doc_id % 10 = 4 THEN 5 ELSE 0 END AS mtime FROM notes WHERE doc_id % 10 <> 2),
now AS (SELECT *, md5(body) AS h FROM isb)"""


def state(a: str, b: str) -> str:
    return f"CASE WHEN {a}.h IS NULL THEN 'added' WHEN {b}.h IS NULL THEN 'deleted' WHEN {a}.h <> {b}.h OR {a}.mtime <> {b}.mtime THEN 'modified' ELSE 'clean' END"


def slug(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'untitled' ELSE {s} END"


#: The rules of a note by its form, with the line of each.
STATED = """
rn AS (SELECT doc_id, status, CAST(doc_id AS VARCHAR) AS i, concat('decisions/n', CAST(doc_id AS VARCHAR), '.md') AS path FROM notes),
sen AS (SELECT doc_id, concat('Forbid `old_', i, '()` in `src/**/*.rs`. -- Remediation: Use new_', i, '.') AS t FROM rn),
hash AS (SELECT doc_id, list_reduce(list_prepend(0, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda a, b: (31 * a + b) % 65536) AS h FROM sen),
own AS (
  SELECT doc_id, status, path, 3 AS place, concat('ADR-', i) AS id, 'forbidden' AS kind, concat('w, ', i) AS pattern, 'src/**/*.rs' AS file_pattern, 'warn' AS severity, 'Use x, y | z.' AS remediation FROM rn WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, status, path, 3, concat('R', i), 'must_contain', concat('need_', i), '*.py', 'warn', concat('Ensure changes include required pattern `need_', i, '`.') FROM rn WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, status, path, 3, concat('RULE-n', i, '-', lpad(lower(to_hex(h)), 4, '0')), 'forbidden', concat('old_', i, '()'), 'src/**/*.rs', 'deny', concat('Use new_', i, '.') FROM rn JOIN hash USING (doc_id) WHERE doc_id % 6 = 2
  UNION ALL SELECT doc_id, status, path, 7, concat('Y', i, '-', CAST(n AS VARCHAR)), 'forbidden', concat(['a', 'b'][n], i), '', 'warn', concat('Remove or replace forbidden pattern `', ['a', 'b'][n], i, '`.') FROM rn, range(1, 3) r(n) WHERE doc_id % 6 = 3
  UNION ALL SELECT doc_id, status, path, -1, concat('T', i, '-1'), 'must_contain', concat('f', i), '*.md', 'deny', concat('Ensure changes include required pattern `f', i, '`. (Supersedes [[old-', i, ']])') FROM rn WHERE doc_id % 6 = 5
  UNION ALL SELECT doc_id, status, path, CASE doc_id % 6 WHEN 3 THEN 9 WHEN 4 THEN 7 ELSE 5 END, concat('S-', CAST(doc_id % 10 AS VARCHAR)), 'forbidden', concat('shared_', CAST(doc_id % 3 AS VARCHAR)), '', 'deny',
    concat('Remove or replace forbidden pattern `shared_', CAST(doc_id % 3 AS VARCHAR), '`.', CASE WHEN doc_id % 6 = 5 THEN concat(' (Supersedes [[old-', i, ']])') ELSE '' END) FROM rn
)"""

def ident(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-_/:.\s\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def some(items: str, var: str, cond: str) -> str:
    return f"len(list_filter({items}, lambda {var}: {cond})) > 0"


PROJECTS = f"""
pj AS (SELECT id, lang, title, lower(regexp_extract(title, '([\\p{{L}}\\p{{N}}]+)', 1)) AS word FROM pg),
dv AS (SELECT dst, list_distinct(list(s.word) FILTER (s.word <> '')) AS d FROM edges JOIN pj s ON s.id = src GROUP BY dst),
kn AS (SELECT id, concat(lang, '/', word, '.md') AS path, CASE WHEN word = '' THEN '.md' ELSE word END AS stem, title, [concat('slug-', CAST(id AS VARCHAR)), concat('p', CAST(id AS VARCHAR))] AS ids, coalesce(d, []) AS der, {ident("concat('topic ', lang)")} AS tag
  FROM pj LEFT JOIN dv ON dst = id),
ks AS (SELECT *, list_concat([stem, title], ids) AS own, list_concat([stem, title], ids, der) AS nl FROM kn),
kp AS (SELECT *, list_transform(nl, lambda x: {ident("x")}) AS nn FROM ks),
dq AS (SELECT doc_id, list_filter({words("substr(text, 1, 60)")}, lambda w: length(w) > 3) AS w FROM documents),
aq AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('P', CAST(doc_id % 300 AS VARCHAR)) WHEN 1 THEN w[1] WHEN 2 THEN concat_ws('_', w[1], w[2]) ELSE concat('slug-', CAST(doc_id % 300 AS VARCHAR), ' slug') END AS query FROM dq),
aw AS (SELECT doc_id, lower(query) AS ql, {ident("query")} AS qn FROM aq WHERE trim(coalesce(query, '')) <> ''),
pr AS (
  SELECT doc_id, id, path, list_contains(own, ql) OR {ident("stem")} = qn OR {ident("title")} = qn AS e,
    regexp_matches(lower(stem), array_to_string(string_split(ql, ''), '.*')) AS s,
    len(string_split(qn, ' ')) > 0 AND qn <> '' AND (
      {some("nl", "x", "starts_with(x, ql) OR contains(x, ql)")}
      OR {some("nn", "x", "x = qn OR contains(x, qn) OR (strlen(x) >= 3 AND starts_with(qn, x)) OR (x <> '' AND (list_has_all(string_split(x, ' '), string_split(qn, ' ')) OR (list_has_all(string_split(qn, ' '), string_split(x, ' ')) AND len(string_split(x, ' ')) >= 2)))")}
      OR starts_with(tag, qn) OR list_has_all(string_split(tag, ' '), string_split(qn, ' '))
      OR len(list_filter(string_split(qn, ' '), lambda y: NOT ({some("list_append(nn, tag)", "x", "contains(x, y)")}))) = 0) AS m
  FROM aw, kp
),
pt AS (
  SELECT doc_id, id, CASE WHEN e THEN 0 WHEN m THEN 1 ELSE 2 END AS tier, 0 AS r, path FROM pr WHERE e OR m OR s
  UNION ALL SELECT query_id, vr.doc_id, 4, r, '' FROM vr JOIN aw ON aw.doc_id = query_id JOIN pg ON pg.id = vr.doc_id WHERE r <= 10 AND distance / 2 <= 0.35
)"""

SQL: dict[str, str] = {
    "estimate_tokens": f"SELECT doc_id, {estimate('text')} AS tokens FROM documents",
    "safe_names": r"""SELECT doc_id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM (
        SELECT doc_id, trim(regexp_replace(translate(concat(' .', substr(text, 1, 60), '?a/b.'), '/\:*?"<>|', '_________'), '^\s+|\s+$', '', 'g'), '.') AS n FROM documents)""",
    "one_line": r"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ')) AS line_md5 FROM documents",
    "ansi_strip": "SELECT doc_id, md5(text) AS plain_md5 FROM documents",
    "unescape": r"""WITH a AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), '\n') ELSE concat(text, '\t\nx') END, CASE WHEN doc_id % 5 = 0 THEN '\n- item' ELSE '' END) AS r FROM documents)
        SELECT doc_id, md5(CASE WHEN contains(r, '\n') AND (NOT contains(r, chr(10)) OR contains(r, '## Non-Negotiable Invariants\n') OR contains(r, '\n- ')) THEN replace(replace(r, '\n', chr(10)), '\t', chr(9)) ELSE r END) AS text_md5 FROM a""",
    "fuzzy_match": """SELECT doc_id, regexp_matches(lower(string_split(text, chr(10))[1]), array_to_string(string_split(lower(concat(lang, source)), ''), '.*')) AS matches FROM documents""",
    "path_keywords": """SELECT doc_id, concat(lower(concat(source, '-', lang, '_v')), ' ', lower(source), ' ', lower(lang), ' mod_', CAST(doc_id % 20 AS VARCHAR), '.test mod ', CAST(doc_id % 20 AS VARCHAR), '.test') AS keywords FROM documents""",
    "scan_filter": f"""WITH {NOTES}, p AS (SELECT doc_id, path, string_split(path, '/') AS s FROM notes), q AS (SELECT doc_id, path, s[1] AS src, s[2] AS lang, s[3] AS f FROM p),
        k AS (SELECT * FROM q WHERE CASE WHEN src = 'src4' AND regexp_matches(f, '^[0-3]') THEN false WHEN f LIKE '%25.md' THEN true WHEN f LIKE '%5.md' THEN false
          ELSE NOT (src = 'src3' AND lang LIKE 'e_') AND src <> 'src1' END)
        SELECT doc_id, path FROM k WHERE f IN ('100.md', '202.md') OR NOT EXISTS (SELECT 1 FROM k z WHERE z.src = k.src AND z.lang = k.lang AND z.f IN ('100.md', '202.md'))""",
    "lifecycle_status": rf"""WITH {NOTES} SELECT doc_id, CASE WHEN status <> 'active' THEN status WHEN doc_id % 13 = 0 THEN 'superseded' WHEN doc_id % 11 = 0 THEN 'archived'
        WHEN len(list_filter(string_split(body, chr(10))[1:5], lambda x: regexp_matches(upper(ltrim(x)), '^> \[(SUPERSEDED\]|!?WARN\] SUPERSEDED)'))) > 0 THEN 'superseded' ELSE 'active' END AS status FROM notes""",
    "hierarchy_classify": """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'L2Log' WHEN doc_id % 7 = 0 THEN 'L3Evergreen'
        ELSE ['L0Ephemeral', 'L1Resource', 'L2Log', 'L3Evergreen', 'L1Resource', 'L3Evergreen'][CAST(doc_id % 6 + 1 AS INTEGER)] END AS hierarchy FROM documents""",
    "stale_after": "SELECT doc_id, strftime(DATE '2024-06-01' + CAST(doc_id % 61 - 30 AS INTEGER), '%Y-%m-%d') AS stale_date, doc_id % 61 - 30 <= -1 AS expired FROM documents",
    "temporal_decay": f"WITH {NOTES} SELECT doc_id, round({decayed('doc_id % 5 = 0')}, 6) AS decay FROM notes",
    "access_debounce": f"WITH RECURSIVE {ACCESS} SELECT * FROM access",
    "access_reinforcement": f"WITH RECURSIVE {ACCESS} SELECT *, round({reinforce('access_count', 'last_access')}, 6) AS reinforcement FROM access",
    "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(len({words('text')})) AS BIGINT) AS total_tokens, round(avg(len({words('text')})), 6) AS avg_len FROM documents",
    "term_df": f"WITH tok AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term",
    "bm25_search": f'WITH {NOTES}, {PHRASES}, {laddered("notes", "")}, {pure("notes", "")} SELECT * FROM f WHERE "rank" <= 10',
    "bm25_tiers": f"""WITH {NOTES}, {PHRASES}, {laddered("notes", "")}
        SELECT query_id AS item_id, CASE WHEN t = 0 THEN 'strict' ELSE 'any' END AS tier, count(*) AS n_hits FROM bm25 GROUP BY ALL""",
    "scoped_search": f"""WITH {NOTES}, scoped AS (SELECT * FROM notes WHERE starts_with(path, 'src1') AND level = 'L3Evergreen'), {PHRASES}, {laddered("scoped", "")}, {pure("scoped", "")}
        SELECT * FROM f WHERE "rank" <= 10""",
    "vector_search": f'WITH {VECTORS} SELECT query_id, doc_id AS vec_id, r AS "rank", round(distance, 6) + 0.0 AS distance FROM vr WHERE r <= 10',
    "section_knn": f"""WITH {VECTORS}, f AS (SELECT query_id, doc_id AS section_id, doc_id // 5 AS doc_id, distance, r, row_number() OVER (PARTITION BY query_id, doc_id // 5 ORDER BY r) AS n FROM vr WHERE r <= 50),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS "rank" FROM f WHERE n = 1)
        SELECT query_id, doc_id, "rank", section_id, r AS section_rank, round(distance, 6) + 0.0 AS distance FROM k WHERE "rank" <= 10""",
    "cosine_dups": f"""WITH {NOTES}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        d AS (SELECT v.id, CASE WHEN v.id % 8 = 7 THEN list_transform(range(1, len(v.e) + 1), lambda i: s * w.e[i] + (1 - s) * v.e[i]) ELSE v.e END AS e
          FROM (SELECT *, CASE WHEN (id // 8) % 7 = 0 THEN 1.0::DOUBLE ELSE CAST(55 + 8 * ((id // 8) % 5) AS DOUBLE) / 100 END AS s FROM v) v LEFT JOIN v w ON w.id = v.id - 4),
        m AS (SELECT d.id, e, min(d.id) OVER (PARTITION BY e) AS rep, count(*) OVER (PARTITION BY e) AS size FROM d JOIN notes n ON n.doc_id = d.id WHERE n.status = 'active' AND n.level = 'L3Evergreen'),
        p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score FROM m a JOIN m b ON a.id = a.rep AND b.id = b.rep AND a.id < b.id),
        x AS (SELECT a.id AS a, b.id AS b, a.rep AS ra, b.rep AS rb, a.size AS na, b.size AS nb FROM m a JOIN m b ON a.id = b.id - 4 AND b.id % 24 = 7),
        y AS (SELECT least(ra, rb) AS a, greatest(ra, rb) AS b FROM x WHERE ra <> rb GROUP BY ra, rb, na, nb HAVING count(*) = na * nb),
        z AS (SELECT id, count(*) AS c FROM (SELECT a AS id FROM x WHERE ra = rb UNION ALL SELECT b FROM x WHERE ra = rb) GROUP BY id)
        SELECT a, b, round(score, 6) AS score, 'cosine' AS kind FROM p WHERE score > 0.88 AND NOT EXISTS (SELECT 1 FROM y WHERE y.a = p.a AND y.b = p.b)
        UNION ALL SELECT rep, m.id, 1.0, 'copy' FROM m LEFT JOIN z ON z.id = m.id WHERE m.id <> rep AND coalesce(c, 0) < size - 1""",
    "pending_sections": f"""WITH {NOTES}, {MUTATED}, c AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM now)),
        o AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM was))
        SELECT c.doc_id, c.ord, md5(c.x) AS text_hash FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.ord = c.ord WHERE o.x IS NULL OR o.x <> c.x""",
    "rrf_fusion": f"WITH {NOTES}, {PHRASES}, {laddered('notes', '')}, {VECTORS}, {FUSED} SELECT query_id, doc_id AS id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, round(score, 6) AS score FROM fused",
    "hybrid_search": f"""WITH RECURSIVE {HYBRID},
        al AS (SELECT query_id, doc_id, bm25_rank, vector_rank, fin, boost, -1 AS via FROM f2 UNION ALL SELECT query_id, id, NULL, NULL, fin, 0.0, parent FROM ex),
        f3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fin, 9) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, doc_id) AS r FROM al)
        SELECT query_id, doc_id AS id, r AS "rank", round(fin, 6) AS score, round(boost, 6) AS graph_boost, via AS expanded_from FROM f3 WHERE r <= 10""",
    "graph_boost": f"""WITH {NOTES}, {PHRASES}, {laddered("notes", "")}, {VECTORS}, {FUSED}, {LINKS}, p AS (SELECT query_id, doc_id, status FROM fused JOIN notes USING (doc_id)),
        live AS (SELECT * FROM p WHERE status = 'active'), bo AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
        lk AS (SELECT DISTINCT x.query_id, x.doc_id, true AS c FROM live x JOIN bo ON a = x.doc_id AND a <> b JOIN live y ON y.query_id = x.query_id AND y.doc_id = b)
        SELECT query_id, doc_id AS id, coalesce(c, false) AS connected FROM p LEFT JOIN lk USING (query_id, doc_id)""",
    "section_locate": f"""WITH {NOTES}, {TERMS}, {bm25("notes", "")},
        h AS (SELECT query_id, doc_id AS d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm25) WHERE r <= 10),
        sl AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS o FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM notes)),
        sec AS (SELECT {{'d': doc_id, 'o': o}} AS doc_id, body FROM sl), {bm25("sec", "x")},
        k AS (SELECT b.query_id, b.doc_id.d AS d, b.doc_id.o AS o, round(score, 9) AS s FROM xbm25 b JOIN h ON h.query_id = b.query_id AND h.d = b.doc_id.d),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id, d ORDER BY s DESC, o) AS n FROM k)
        SELECT query_id AS item_id, d AS doc_id, o AS ord, round(s, 6) AS score FROM z WHERE n = 1""",
    "federated_search": f"""WITH {NOTES}, own AS (SELECT * FROM notes WHERE doc_id % 2 = 0), shared AS (SELECT * FROM notes WHERE doc_id % 2 = 1), {PHRASES}, {laddered("own", "o")}, {laddered("shared", "g")},
        o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM obm25),
        g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM gbm25),
        o2 AS (SELECT query_id, o1.doc_id, md5(body) AS h, 'primary' AS scope, f * CASE WHEN status = 'active' THEN 1.0 ELSE 0.2 END / (60 + r) AS s FROM o1 JOIN own USING (doc_id) WHERE r <= 20),
        g2 AS (SELECT query_id, g1.doc_id, md5(body) AS h, 'global' AS scope, 0.7 * f * CASE WHEN status = 'active' THEN 1.0 ELSE 0.2 END / (60 + r) AS s FROM g1 JOIN shared USING (doc_id) WHERE r <= 20),
        a AS (SELECT * FROM o2 UNION ALL SELECT * FROM g2 WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.query_id = g2.query_id AND o2.h = g2.h)),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, scope DESC, doc_id) AS r FROM a)
        SELECT query_id AS item_id, doc_id, scope, r AS "rank", round(s, 6) AS score FROM z WHERE r <= 10""",
    "link_resolve": f"WITH {LINKS} SELECT src, pos, resolution, CASE WHEN resolution = 'document' THEN dst ELSE -1 END AS dst FROM res",
    "link_edges": f"WITH {LINKS} SELECT src, dst FROM edges",
    "link_stats": f"WITH {LINKS} SELECT resolution, count(*) AS n FROM res GROUP BY 1",
    "backlinks": f"""WITH {LINKS} SELECT id AS page_id, (SELECT count(*) FROM edges WHERE dst = id) AS in_links, (SELECT count(*) FROM edges WHERE src = id) AS out_links FROM pn""",
    "graph_expand": f"WITH RECURSIVE {HYBRID} SELECT query_id, id AS neighbour, parent, round(fin, 9) AS score FROM ex",
    "orphans": f"""WITH {LINKS} SELECT id AS page_id FROM gn WHERE status = 'active' AND level <> 'L0Ephemeral' AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)""",
    "broken_links": f"WITH {LINKS} SELECT src, raw_target FROM res WHERE resolution = 'broken'",
    "weave_plan": f"""WITH {LINKS}, e AS (SELECT DISTINCT dst, concat(s.p, '|', s.title) AS entry FROM edges JOIN gn t ON t.id = dst JOIN gn s ON s.id = src
        WHERE t.status = 'active' AND t.level = 'L3Evergreen' AND s.level IN ('L1Resource', 'L3Evergreen')) SELECT dst, string_agg(entry, '; ' ORDER BY entry) AS sources FROM e GROUP BY 1""",
    "graph_export": f"WITH {LINKS} SELECT DISTINCT concat(s.p, '.md') AS src_path, concat(t.p, '.md') AS dst_path FROM edges JOIN pn s ON s.id = src JOIN pn t ON t.id = dst",
    "supersession_chain": f"""WITH RECURSIVE {NOTES}, nx AS (SELECT a.doc_id AS id, b.doc_id AS nxt FROM notes a LEFT JOIN notes b ON a.status <> 'active' AND b.doc_id = a.doc_id + 3),
        w AS (SELECT id, id AS cur, CAST(0 AS BIGINT) AS hops FROM nx UNION ALL SELECT w.id, nx.nxt, w.hops + 1 FROM w JOIN nx ON nx.id = w.cur WHERE nx.nxt IS NOT NULL AND w.hops < 16)
        SELECT id AS doc_id, max_by(cur, hops) AS final_id, max(hops) AS hops FROM w GROUP BY 1""",
    "near_dups": f"""WITH {SETS}, j AS (SELECT a.low AS a, b.low AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM nodes a JOIN nodes b ON a.low < b.low
        AND least(len(a.w), len(b.w)) >= 0.6 * greatest(len(a.w), len(b.w)))
        SELECT a, b, round(i / CAST(n + m - i AS DOUBLE), 6) AS jaccard FROM j WHERE i / CAST(n + m - i AS DOUBLE) >= 0.6""",
    "guard_forbidden": f"WITH {NOTES}, {RULED} SELECT * FROM bad",
    "guard_must_contain": f"WITH {NOTES}, {RULED} SELECT * FROM lack",
    "guard_report": f"""WITH {NOTES}, {RULED}, a AS (SELECT doc_id, severity FROM bad UNION ALL SELECT doc_id, severity FROM lack)
        SELECT n.doc_id, count(severity) AS violations, count(*) FILTER (severity = 'deny') = 0 AS is_passed FROM notes n LEFT JOIN a ON a.doc_id = n.doc_id GROUP BY 1""",
    "guard_diff": rf"""WITH {NOTES}, {RULED}, f AS (SELECT doc_id, path, max(line_no) AS n, max(CASE WHEN line_no = 1 AND regexp_matches(line, '\bthe\b') THEN 1 ELSE 0 END) AS lost,
          max(CASE WHEN line_no > 1 AND regexp_matches(line, '\bthe\b') THEN 1 ELSE 0 END) AS has FROM lines GROUP BY ALL)
        SELECT doc_id AS diff_id, rule_id, line_no - 1 AS line_no FROM bad WHERE line_no > 1
        UNION ALL SELECT doc_id, 'R3', 1 FROM f WHERE regexp_matches(path, '^(.*/)?src1[^/]*/.*$') AND has = 0 AND (lost = 1 OR n > 1)""",
    "guard_comments": rf"""WITH x AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        t AS (SELECT doc_id, line_no, doc_id % 3 AS lang, (doc_id + line_no - 1) % 6 AS kind, regexp_matches(regexp_replace(raw, '[^A-Za-z ]', '', 'g'), '\bpassword\b') AS said FROM x)
        SELECT 'C1' AS rule_id, doc_id, line_no, 'deny' AS severity FROM t WHERE lang = 2 OR kind IN (1, 5) OR (kind = 0 AND lang = 1) OR (kind = 3 AND lang = 0) OR (kind IN (0, 2, 3) AND said)
        UNION ALL SELECT 'C2', doc_id, line_no, 'warn' FROM t""",
    "guard_rules": f"WITH {NOTES}, {STATED} SELECT doc_id, place, id, kind, pattern, file_pattern, severity, remediation FROM own WHERE status = 'active'",
    "guard_resurrection": f"""WITH {NOTES}, {STATED},
        live AS (SELECT doc_id FROM rn WHERE status = 'active' AND doc_id % 7 NOT IN (1, 2)),
        cur AS (SELECT o.*, 'current' AS state FROM own o JOIN live USING (doc_id) WHERE (doc_id % 7 <> 3 OR place = -1) AND NOT (place = -1 AND doc_id % 7 = 5 AND doc_id % 2 = 0)),
        old AS (SELECT o.*, 'resurrected' AS state FROM own o WHERE status = 'active' AND (doc_id % 7 = 3 OR (doc_id % 7 = 5 AND doc_id % 2 = 0)
          OR (doc_id % 7 = 1 AND NOT (doc_id % 2 = 0 AND doc_id + 4 IN (SELECT doc_id FROM live))) OR (doc_id % 7 = 2 AND doc_id + 1 NOT IN (SELECT doc_id FROM live)))),
        r AS (SELECT *, row_number() OVER (PARTITION BY id, kind, pattern ORDER BY state, path, place) AS n FROM (SELECT * FROM cur UNION ALL SELECT * FROM old))
        SELECT doc_id, id, kind, pattern, state FROM r WHERE n = 1""",
    "rule_dedup": f"""WITH {NOTES}, r AS (SELECT concat('R', CAST(doc_id % 50 AS VARCHAR)) AS id, substr(title, 1, 5) AS pattern, path AS source, doc_id FROM notes)
        SELECT id, pattern, source FROM (SELECT *, row_number() OVER (PARTITION BY id, pattern ORDER BY doc_id) AS n FROM r) WHERE n = 1""",
    "gc_turns": f"WITH {TURNS} SELECT conv_id, turn, CAST(tier AS BIGINT) AS fold_tier, tokens AS tokens_after FROM folded",
    "gc_summary": f"""WITH {TURNS}, s AS (SELECT conv_id, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(tokens) AS BIGINT) AS compacted_tokens, count(*) FILTER (tier >= 2) AS folded FROM folded GROUP BY 1)
        SELECT *, CASE WHEN raw_tokens > 0 THEN round(greatest(raw_tokens - compacted_tokens, 0) * 100.0 / CAST(raw_tokens AS DOUBLE), 6) ELSE 0.0 END AS trr,
          compacted_tokens / 128000.0 BETWEEN 0.15 AND 0.6 AS in_smart_zone FROM s""",
    "offload": f"SELECT doc_id, CAST({n_lines('text')} AS BIGINT) AS total_lines, {n_lines('text')} > 5 AS truncated, CASE WHEN {n_lines('text')} > 5 THEN concat('node_', substr(md5(text), 1, 8)) END AS node_id FROM documents",
    "dirty_sets": f"WITH {NOTES}, {MUTATED} SELECT {state('was', 'now')} AS state, count(*) AS n FROM was FULL JOIN now ON was.path = now.path GROUP BY 1",
    "section_diff": f"""WITH {NOTES}, {MUTATED},
        s AS (SELECT doc_id, 1 AS side, unnest(string_split(body, chr(10))) AS x FROM was UNION ALL SELECT doc_id, 2, unnest(string_split(body, chr(10))) FROM now),
        c AS (SELECT doc_id, x, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM s GROUP BY ALL)
        SELECT doc_id, CAST(sum(least(a, b)) AS BIGINT) AS reused, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS inserted, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS deleted FROM c GROUP BY 1""",
    "index_maintenance": f"""WITH {NOTES}, {MUTATED}, x AS (SELECT doc_id, string_split(path, '/')[1] AS tag, concat(string_split(body, chr(10))[1], ' ', string_split(path, '/')[1], ' note ', body) AS t, string_split(body, chr(10)) AS l FROM now),
        w AS (SELECT doc_id, unnest({words("t")}) AS term FROM x), s AS (SELECT doc_id, unnest(range(0, len(l))) AS ord FROM x)
        SELECT 'documents' AS name, count(*) AS n_rows, count(DISTINCT doc_id) AS n_notes, CAST(sum(len({words("t")})) AS BIGINT) AS total FROM x
        UNION ALL SELECT 'postings', count(*), count(DISTINCT doc_id), CAST(sum(tf) AS BIGINT) FROM (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)
        UNION ALL SELECT 'links', count(*), count(DISTINCT doc_id), count(*) FROM x UNION ALL SELECT 'tags', 2 * count(*), count(DISTINCT doc_id), CAST(sum(4 + length(tag)) AS BIGINT) FROM x
        UNION ALL SELECT 'sections', count(*), count(DISTINCT doc_id), CAST(sum(ord) AS BIGINT) FROM s""",
    "vector_dirty": f"""WITH v AS (SELECT vec_id AS id, CASE WHEN label = 3 THEN 'old' ELSE 'h' END AS h, 0 AS mtime FROM embeddings), d AS (SELECT doc_id AS id, 'h' AS h, 0 AS mtime FROM documents)
        SELECT {state("v", "d")} AS state, count(*) AS n FROM v FULL JOIN d ON v.id = d.id GROUP BY 1""",
    "index_health": """WITH r AS (SELECT d.doc_id AS d, text, v.vec_id AS v FROM documents d FULL JOIN embeddings v ON d.doc_id = v.vec_id)
        SELECT 'documents' AS metric, count(d) AS value FROM r UNION ALL SELECT 'empty', count(*) FILTER (d IS NOT NULL AND trim(coalesce(text, '')) = '') FROM r
        UNION ALL SELECT 'covered', count(*) FILTER (d IS NOT NULL AND v IS NOT NULL) FROM r UNION ALL SELECT 'orphan_vectors', count(*) FILTER (d IS NULL) FROM r""",
    "timeline": f"""WITH {NOTES} SELECT row_number() OVER (ORDER BY strftime(to_timestamp(mtime), '%Y-%m-%d') DESC, mtime DESC, path) AS rn, doc_id,
        CASE level WHEN 'L3Evergreen' THEN 'decision' WHEN 'L2Log' THEN 'log' ELSE 'ephemeral' END AS kind, strftime(to_timestamp(mtime), '%Y-%m-%d') AS date
        FROM notes WHERE level <> 'L1Resource'""",
    "pack_filter": f"""WITH {NOTES} SELECT doc_id, level FROM notes WHERE level IN ('L3Evergreen', 'L2Log') AND (contains(lower(title), 'the') OR contains(lower(body), 'the') OR contains(lower(path), 'the'))""",
    "flush_dedup_names": f"""WITH {NOTES}, s AS (SELECT doc_id, level, {slug("title")} AS slug, md5(body) AS h FROM notes), g AS (SELECT level, slug, h, min(doc_id) AS f FROM s GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY level, slug ORDER BY f) AS n FROM g)
        SELECT doc_id, concat(s.slug, CASE WHEN n > 1 THEN concat('-v', CAST(n AS VARCHAR)) ELSE '' END, '.md') AS file_name FROM s JOIN n ON s.level = n.level AND s.slug = n.slug AND s.h = n.h""",
    "category_normalize": """SELECT doc_id, ['', 'Card', 'adr', 'wiki', ' Journal ', 'projects', 'recipe', 'other'][CAST(doc_id % 8 + 1 AS INTEGER)] AS raw,
        CASE doc_id % 8 WHEN 0 THEN 'log' WHEN 1 THEN CASE WHEN contains(text, '## Non-Negotiable Invariants') THEN 'decision' ELSE 'concept' END WHEN 2 THEN 'decision' WHEN 3 THEN 'concept'
          WHEN 4 THEN 'log' WHEN 5 THEN 'project' WHEN 6 THEN 'skill' ELSE 'other' END AS category FROM documents""",
    "loadout_rank": f"""WITH {NOTES}, k AS (SELECT item_id AS query_id, list_sort(list_distinct({words("text")}))[1:6] AS ks FROM benchmark),
        c AS (SELECT query_id, doc_id, title, level, CAST(coalesce(list_sum(list_transform(list_filter(ks, lambda k: strlen(k) > 1), lambda k: (CASE WHEN lower(title) = k THEN 20 WHEN contains(lower(title), k) THEN 10 ELSE 0 END)
            + (CASE WHEN contains(lower(path), k) THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(title), k) THEN 3 ELSE 0 END))), 0) + CASE WHEN level = 'L3Evergreen' THEN 1 ELSE 0 END AS BIGINT) AS score
          FROM notes, k WHERE status = 'active'),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(title), doc_id) AS n FROM c WHERE score > 1)
        SELECT query_id, doc_id, score, n AS "rank" FROM r WHERE n <= 10""",
    "card_concepts": f"""WITH {NOTES}, c AS (SELECT doc_id, trim(concat('C ', title)) AS x FROM notes WHERE status = 'active')
        SELECT doc_id, CASE WHEN length(x) > 100 THEN concat(rtrim(substr(x, 1, 90)), '...') ELSE x END AS concept FROM c""",
    "loadout_text": f"""WITH {NOTES}, k AS (SELECT item_id AS query_id, text, list_sort(list_distinct({words("text")}))[1:6] AS ks FROM benchmark),
        cd AS (SELECT doc_id, title, path, level, CASE WHEN length(x) > 100 THEN concat(rtrim(substr(x, 1, 90)), '...') ELSE x END AS concept FROM (SELECT *, trim(concat('C ', title)) AS x FROM notes WHERE status = 'active')),
        c AS (SELECT query_id, doc_id, title, concept, CAST(coalesce(list_sum(list_transform(list_filter(ks, lambda k: strlen(k) > 1), lambda k: (CASE WHEN lower(title) = k THEN 20 WHEN contains(lower(title), k) THEN 10 ELSE 0 END)
            + (CASE WHEN contains(lower(path), k) THEN 4 ELSE 0 END) + (CASE WHEN contains(lower(concept), k) THEN 3 ELSE 0 END))), 0) + CASE WHEN level = 'L3Evergreen' THEN 1 ELSE 0 END AS BIGINT) AS score FROM cd, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(title), doc_id) AS n FROM c WHERE score > 1),
        ln AS (SELECT query_id, n, concat('- **[[', CAST(doc_id AS VARCHAR), ']]**: ', concept) AS line FROM r WHERE n <= 4),
        ls AS (SELECT query_id, list(line ORDER BY n) AS lines FROM ln GROUP BY 1),
        h AS (SELECT k.query_id, repeat(replace(text, chr(10), ' '), CASE WHEN k.query_id % 4 = 0 THEN 4 ELSE 1 END) AS scope, coalesce(lines, []) AS lines, CASE WHEN k.query_id % 3 = 0 THEN ['- [[log one]]', '- [[log two]]'] ELSE ['- *(no recent log)*'] END AS logs,
          concat('> **Active Changes**: ', CAST(greatest(least(len(ks), 3), 1) AS VARCHAR), ' modified modules: ', array_to_string(list_transform(ks[1:3], lambda m: concat('`', CASE WHEN length(m) > 30 THEN concat(substr(m, 1, 27), '...') ELSE m END, '`')), ', '),
            ' (', CAST(len(ks) AS VARCHAR), ' files)') AS ch FROM k LEFT JOIN ls USING (query_id)),
        g AS (SELECT *, CASE WHEN length(ch) > 100 THEN concat(substr(ch, 1, 97), '...') ELSE ch END AS cl FROM h),
        v AS (SELECT query_id, lines, mode, n, CASE WHEN mode = 2 AND n > 1 THEN concat(substr(scope, 1, 60), '...') WHEN mode = 2 THEN substr(scope, 1, 60) ELSE scope END AS sc, scope, cl, logs FROM g, range(1, 3) m(mode), range(0, 5) t(n) WHERE n <= len(lines)),
        tx AS (SELECT *, array_to_string(list_concat([concat('# Loadout: Q', CAST(query_id AS VARCHAR), ' [diff-aware]'), cl, concat('> **Scope**: ', sc), '', '## Knowledge and constraints (L3)'],
            CASE WHEN n = 0 THEN ['- *(no rule or decision matches these modules)*'] ELSE lines[1:n] END, ['', '## Recent decisions (L2)'], logs, ['', '## Protocol', '1. Audit the diff before a commit; a note that replaces a decision names it.']), chr(10)) AS t FROM v),
        e AS (SELECT *, {estimate("t")} AS tk FROM tx),
        md AS (SELECT query_id, CASE WHEN bool_or(mode = 1 AND n = 1 AND tk <= 280) THEN 1 WHEN bool_or(mode = 2 AND n = 1 AND tk <= 280) THEN 2 ELSE 0 END AS md FROM e GROUP BY 1),
        nc AS (SELECT e.query_id, any_value(md) AS md, coalesce(max(CASE WHEN mode = md AND n > 0 AND tk <= 280 THEN n END), 0) AS nc FROM e JOIN md USING (query_id) GROUP BY 1),
        o AS (SELECT e.query_id, nc, CASE WHEN md = 2 AND nc = 1 THEN replace(t, concat('> **Scope**: ', sc), concat('> **Scope**: ', sc, '...')) ELSE t END AS t, scope, cl FROM nc JOIN e ON e.query_id = nc.query_id AND e.n = nc.nc AND e.mode = greatest(md, 1))
        SELECT query_id, CAST(nc AS BIGINT) AS n_cards, {estimate("t")} AS tokens, md5(t) AS text_md5 FROM o""",
    "find_project": f"""WITH {LINKS}, {VECTORS}, {PROJECTS}, z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, r, path, id) AS n FROM pt)
        SELECT doc_id AS query_id, id AS project, ['exact', 'match', 'subsequence', 'text', 'vector'][tier + 1] AS tier FROM z WHERE n = 1""",
    "distil_skills": r"""WITH RECURSIVE w AS (SELECT conv_id, turn, substr(regexp_replace(text, '(?s)[^A-Za-z].*$', ''), 1, 20) AS f, (turn + conv_id) % 6 AS k FROM conversations),
        u AS (SELECT conv_id, turn, unnest(x) AS t, generate_subscripts(x, 1) AS part, k FROM (SELECT conv_id, turn, k, CASE k WHEN 0 THEN [concat('$ cargo ', f)] WHEN 1 THEN [concat('  error: ', f, ' failed')] WHEN 2 THEN [concat('plain ', f)]
          WHEN 3 THEN ['Traceback (most recent call last):', '  File x.py, line 1', concat('KeyError: ', f)] WHEN 4 THEN ['test result: 0 FAILED'] ELSE [concat('git ', f)] END AS x FROM w)),
        l AS (SELECT conv_id, k, part, rtrim(t) AS t, trim(t) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS i FROM u),
        b AS (SELECT *, coalesce(max(CASE WHEN k IN (1, 4) OR (k = 3 AND part = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM l),
        walk AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, false AS ins, CAST([] AS VARCHAR[]) AS got FROM (SELECT DISTINCT conv_id FROM l)
          UNION ALL
          SELECT w.conv_id, b.i, (w.ins OR o) AND NOT ((b.k IN (0, 4) AND len(w.got) + 1 > 2) OR len(w.got) + 1 >= 25), CASE WHEN w.ins OR o THEN list_append(w.got, b.t) ELSE w.got END
          FROM walk w JOIN (SELECT *, k = 1 OR (k = 3 AND part = 1) AS o FROM b) b ON b.conv_id = w.conv_id AND b.i = w.i + 1
        ),
        er AS (SELECT conv_id, max_by(got, i) AS got FROM walk GROUP BY 1),
        a AS (SELECT conv_id, string_agg(CASE WHEN k = 0 THEN trim(substr(s, 3)) ELSE s END, chr(10) ORDER BY i) FILTER ((k = 0 OR (k = 5 AND s <> 'git')) AND seen = 0) AS cb,
            string_agg(CASE WHEN k = 0 THEN trim(substr(s, 3)) ELSE s END, chr(10) ORDER BY i) FILTER ((k = 0 OR (k = 5 AND s <> 'git')) AND seen = 1) AS ca,
            max_by(s, i) FILTER (k = 3 AND part = 3) AS tb, min_by(s, i) FILTER (k = 1) AS e1, bool_or(k = 0) AS rs, bool_or(k = 3) AS py FROM b GROUP BY 1),
        z AS (SELECT a.*, got, coalesce(tb, e1, CASE WHEN a.conv_id % 5 = 0 THEN 'a hint' END, 'Execution interrupted or troubleshooting check') AS summary FROM a JOIN er USING (conv_id))
        SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'a hint' WHEN summary LIKE 'Execution interr%' THEN 'Execution Troubleshooting & Skill Distillation' ELSE concat('Resolve ', trim(regexp_replace(summary, '^error: ', ''))) END AS title, summary,
          concat('type/skill', CASE WHEN rs THEN chr(10) || 'topic/rust' ELSE '' END, CASE WHEN py THEN chr(10) || 'topic/python' ELSE '' END) AS tags,
          coalesce(cb, '') AS commands_before, coalesce(ca, '') AS commands_after, array_to_string(got, chr(10)) AS error_lines FROM z""",
    "handoff_claim": """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_type = 'error'),
        c AS (SELECT event_id AS handoff_id, CASE WHEN user_id % 2 = 0 THEN concat('agent', CAST(user_id % 5 AS VARCHAR)) END AS to_agent, concat('agent', CAST((event_id + i) % 5 AS VARCHAR)) AS agent, ts + i * 20000 AS t, ts
          FROM e, range(6) r(i)),
        k AS (SELECT *, row_number() OVER (PARTITION BY handoff_id ORDER BY t, agent) AS n FROM c WHERE (to_agent IS NULL OR to_agent = agent) AND t < ts + 86400)
        SELECT handoff_id, agent, t AS claimed_ts FROM k WHERE n = 1""",
}
