"""DuckDB SQL for the queries that SQL can express.  It states the results, not the method."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _node(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    tail = f"regexp_extract({_rest(bare)}, '(?s)^[^/?#]*(.*)$', 1)"
    return (
        f"CASE WHEN instr({bare}, '://') > 0 THEN translate(split_part({bare}, '://', 1), '{_UPPER}', '{_LOWER}') || '://' || "
        f"{_host(_rest(bare))} || CASE WHEN {tail} = '' THEN '/' ELSE {tail} END END"
    )


_RULES = """VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')"""
_FIT = """(u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)"""

OP1 = f"""
WITH RECURSIVE rules(h, p, action) AS ({_RULES}),
own AS (
  SELECT page_id, coalesce({_host(_rest('url'))}, '') AS host,
         coalesce(regexp_extract({_rest('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path, {_node('url')} AS node
  FROM pages),
tags AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'),
      lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),
      lambda x: regexp_extract(x, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS raw
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (
  SELECT url, replace(raw, '&amp;', '&') AS href, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin,
         regexp_extract(url, '^([^:/?#]+://[^/?#]*(?:/[^/?#]*)*)/[^/?#]*', 1) AS folder
  FROM tags WHERE raw <> ''),
targets AS (
  SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href
    WHEN starts_with(href, '/') THEN origin || href
    ELSE CASE WHEN folder = '' THEN origin ELSE folder END || '/' || href END AS target FROM links),
edges AS (SELECT {_node('url')} AS a, {_node('target')} AS b FROM targets),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
seen AS (
  SELECT DISTINCT b AS node, coalesce({_host(_rest('b'))}, '') AS host,
         coalesce(regexp_extract({_rest('b')}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM reach),
judged_nodes AS (
  SELECT u.node, arg_max(r.action, length(r.h || r.p)) AS action FROM seen u JOIN rules r ON {_FIT} GROUP BY u.node),
parts AS (
  SELECT r.a AS node, bool_or(j.action = 'allow') AS allowed, bool_or(j.action = 'block') AS blocked
  FROM reach r LEFT JOIN judged_nodes j ON j.node = r.b GROUP BY r.a),
best AS (
  SELECT u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
  FROM own u JOIN rules r ON {_FIT} GROUP BY u.page_id)
SELECT o.page_id, o.host, o.path, b.rule, coalesce(b.action,
         CASE WHEN p.allowed THEN 'allow' WHEN p.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN best b USING (page_id) LEFT JOIN parts p ON p.node = o.node
"""

_KINDS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "ident": r"(?i:client_?id|access_?key_?id|account_?id|user_?name|user|login)[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.@=-]{3,}",
    "value": "[A-Za-z0-9+/_=-]{16,}",
    "endpoint": r"(?i:https?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp)://[^\s\"''<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?",
}
_KEEP = {
    "assign": f"length(regexp_extract(hit, '{_KINDS['assign']}', 1)) >= 6",
    "access": "length(hit) >= 20",
    "hex": "true",
    "ident": "true",
    "value": "regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')",
    "endpoint": "true",
}


def _found(rank: int, kind: str) -> str:
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY pos) - length(hit) AS start FROM (
      SELECT doc_id, unnest(regexp_extract_all(t, '{_KINDS[kind]}')) AS hit,
             unnest(string_split_regex(t, '{_KINDS[kind]}')[1:len(regexp_extract_all(t, '{_KINDS[kind]}'))]) AS gap,
             generate_subscripts(regexp_extract_all(t, '{_KINDS[kind]}'), 1) AS pos
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
  WHERE {_KEEP[kind]}"""


def _apart(kind: str, *others: str) -> str:
    joined = " UNION ALL ".join(f"SELECT * FROM {o}" for o in others)
    return (
        f"{kind} AS (SELECT * FROM {kind}_all w WHERE NOT EXISTS (SELECT 1 FROM ({joined}) b "
        "WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop))"
    )


_NEAR = "EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.kind IN ({0}) AND p.start <= w.stop + 200 AND p.stop >= w.start - 200)"
_I, _V = _NEAR.format("'access', 'ident'"), _NEAR.format("'assign', 'hex', 'value'")
_LINE = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank), '')"

OP2 = f"""
WITH {', '.join(f"{k if r < 3 else k + '_all'} AS ({_found(r, k)})" for r, k in enumerate(_KINDS))},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
{_apart('ident', 'base')}, {_apart('endpoint', 'base', 'ident')}, {_apart('value', 'base', 'ident', 'endpoint')},
weak AS (SELECT * FROM ident UNION ALL SELECT * FROM value UNION ALL SELECT * FROM endpoint),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (
  SELECT * FROM weak w WHERE (kind = 'value' AND {_I}) OR (kind = 'ident' AND {_V}) OR (kind = 'endpoint' AND {_I} AND {_V})),
b AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, {_LINE} AS line FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {_LINE} AS line FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT key, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1 AS k FROM d GROUP BY key),
w AS (SELECT *, ([5, 2, 1][k % 3 + 1])::DOUBLE AS w, 2 * n AS cap FROM s),
o AS (
  SELECT *, (sum(n) OVER () * 150 / 100 - (sum(cap) OVER (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING) - cap))
    / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING) - w)) AS level FROM w),
l AS (SELECT arg_min(level, cap / w) AS level FROM o WHERE level <= cap / w),
t AS (SELECT key, n, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * w) END AS target FROM w CROSS JOIN l),
c AS (SELECT key, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE 0 END AS class, sum(size)::DOUBLE AS words FROM d GROUP BY ALL),
r AS (
  SELECT key, class, n, target, pow(0.9, class) AS f, (target - 2 * (sum(words) OVER (PARTITION BY key ORDER BY class) - words))
    / nullif(sum(words * pow(0.9, class)) OVER (PARTITION BY key ORDER BY class DESC), 0) AS rate FROM c JOIN t USING (key)),
g AS (SELECT key, min(class) AS first, arg_min(rate, class) AS rate FROM r WHERE rate * f <= 2 GROUP BY key),
e AS (
  SELECT r.key, class, n, target, CASE WHEN first IS NULL OR class < first THEN 2.0::DOUBLE ELSE greatest(0.0, least(2.0, g.rate * f))::DOUBLE END AS expected
  FROM r LEFT JOIN g USING (key)),
u AS (
  SELECT d.doc_id, d.key, d.size, n, target, floor(expected)::INT AS certain, expected - floor(expected) AS p,
    (('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN e ON d.key = e.key AND e.class = CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE 0 END),
q AS (SELECT *, CASE WHEN p > 1e-12 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds, target - sum(certain * size) OVER (PARTITION BY key) AS need FROM u),
x AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY odds / (1 + odds), doc_id ROWS UNBOUNDED PRECEDING) <= need AS chosen FROM q WHERE odds IS NOT NULL),
gap AS (SELECT key, any_value(need) - coalesce(sum(size) FILTER (chosen), 0) AS gap FROM x GROUP BY key),
z AS (
  SELECT arg_min(doc_id, (abs(gap - size), odds / (1 + odds), doc_id)) AS doc_id, min(abs(gap - size)) AS miss, any_value(gap) AS gap
  FROM x JOIN gap USING (key) WHERE NOT chosen GROUP BY key)
SELECT q.doc_id, q.size, q.n::BIGINT AS source_size, q.target,
  ((q.certain + CASE WHEN x.chosen OR z.doc_id IS NOT NULL THEN 1 ELSE 0 END) * q.size)::BIGINT AS taken
FROM q LEFT JOIN x ON x.doc_id = q.doc_id LEFT JOIN z ON z.doc_id = q.doc_id AND z.miss < z.gap
"""

OP4 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at
  FROM documents WHERE text IS NOT NULL),
flat AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS f FROM lines),
wide AS (SELECT f, min(doc_id) AS first_doc FROM flat WHERE f <> '' GROUP BY f HAVING count(DISTINCT source) >= 8),
marked AS (SELECT flat.*, wide.f IS NOT NULL AND doc_id <> first_doc AS gone FROM flat LEFT JOIN wide ON flat.f = wide.f)
SELECT d.doc_id, coalesce(max(len(string_split(d.text, chr(10)))), 0)::BIGINT AS n_lines,
       count(*) FILTER (m.gone)::BIGINT AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.at) FILTER (NOT m.gone), '') END AS text
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""

OP6 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least_id, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

#: The fixed counts of the quality query; its classifier isn't SQL, so a test holds these against it.
OP8_RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT pos) AS n FROM twice GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

OP10 = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50)),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM windows),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM firsts WHERE first < doc_id),
each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM each ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The main text where an article element holds it, as in the test tables; statistics of sites aren't in it.
_DECODED = """replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', '''')"""
OP11 = f"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:h1|p)>') AS bs FROM pages),
plain AS (SELECT *, list_transform(bs, lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS ts FROM parts),
decoded AS (SELECT *, list_transform(ts, lambda b: trim(regexp_replace(regexp_replace({_DECODED}, '&amp;?', '&', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS ds FROM plain),
joined AS (SELECT page_id, url, coalesce(array_to_string(list_filter(ds, lambda b: b <> ''), chr(10) || chr(10)), '') AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

#: CRC-32 of a text column, by its table: steps gives the table, then bytes are folded in.
_CRC_TABLE = """steps(b, k, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """text's CRC-32 where crc_table is joined in."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::UBIGINT)"
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1]))"
    return f"xor({folded}, 4294967295::UBIGINT)"


def _best(*options: str) -> str:
    """The least of cost, audit and rows, each option (state, cost, letter, row or nothing)."""
    made = (f"{{'c': {s}.c + {c}, 'a': {s}.a || '{l}', 't': {f'list_append({s}.t, {row})' if row else f'{s}.t'}}}" for s, c, l, row in options)
    return f"list_sort([{', '.join(made)}])[1]"


def _inserted(source: str, as_: str) -> str:
    """One more inserted row, or none, for all states of a table of states s0 to s3."""
    return (
        f"SELECT * EXCLUDE (s2, s3), {_best(('s2', 0, '', ''), ('s0', 5, 'I', chr(39) + 'user:' + chr(39)), ('s1', 5, 'I', chr(39) + 'user:' + chr(39)), ('s3', 5, 'I', chr(39) + 'user:' + chr(39)))} AS s2, "
        f"{_best(('s3', 0, '', ''), ('s2', 5, 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM ({source}) {as_}"
    )


_FAR = "{'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_STAY = "CASE WHEN gone OR initial <> '{0}' THEN 1000000000000 ELSE more END"
_TAKEN = {
    "s0": (("s0", 2, "D", ""),),
    "s1": (("s1", 2, "D", ""), ("s0", _STAY.format("s"), "K", "role || ':' || text")),
    "s2": (
        ("s2", 2, "D", ""),
        *((s, _STAY.format("u"), "K", "role || ':' || text") for s in ("s0", "s1", "s3")),
        *((s, "CASE WHEN gone THEN 1000000000000 ELSE 1 + more END", "R", "'user:' || text") for s in ("s0", "s1", "s3")),
    ),
    "s3": (
        ("s3", 2, "D", ""), ("s2", _STAY.format("a"), "K", "role || ':' || text"),
        ("s2", "CASE WHEN gone THEN 1000000000000 ELSE 1 + more END", "R", "'assistant:' || text"),
    ),
}
#: Cheapest repairs, forward over rows, with audit and rows for each state of the pattern.
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
faulty AS (
  SELECT conv_id, turn, role, text, pos, initial, before, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND cut AS truncated,
         blank OR seen AS gone, CASE WHEN NOT blank AND NOT seen AND cut THEN 5 ELSE 0 END AS more
  FROM judged),
paths(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {_FAR}, {_FAR}, {_FAR} FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT conv_id, pos, {', '.join(_best(*_TAKEN[s]) for s in ('s0', 's1', 's2', 's3'))}
  FROM ({_inserted(_inserted('SELECT p.s0, p.s1, p.s2, p.s3, f.* FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1', 'one'), 'two')}) g),
finished AS (
  SELECT conv_id, {_best(('s0', 0, '', ''), ('s3', 0, '', ''))} AS best
  FROM ({_inserted(_inserted('SELECT * FROM paths p WHERE pos = (SELECT max(pos) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id)', 'one'), 'two')}) g),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
         count_if(truncated) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
terms AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ws FROM documents),
wanted AS (SELECT unnest({_TERMS}) AS w FROM benchmark),
each AS (SELECT row, unnest(ws) AS w FROM terms),
hashed AS (SELECT w, ({_crc32('w')} % 10000)::BIGINT AS bucket FROM (SELECT w FROM each UNION SELECT w FROM wanted), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000))))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket)),
weights AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM terms LEFT JOIN weights USING (row)),
drawn AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM scored LEFT JOIN drawn USING (row)
"""

ORACLE = {
    "op1_url_filters": OP1,
    "op2_secret_scans": OP2,
    "op3_source_mixing": OP3,
    "op4_line_dedup": OP4,
    "op6_ngram_jaccard": OP6,
    "op10_substring_dedup": OP10,
    "op11_html_extraction": OP11,
    "op12_conversation_repair": OP12,
    "op13_importance_resampling": OP13,
}
