"""DuckDB SQL for the queries of this subpackage that SQL can express."""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT arg_min(level, cap::DOUBLE / w::DOUBLE) AS lvl FROM l WHERE level * w <= cap),
g AS (SELECT source, source_size, CASE WHEN cap < lvl * w THEN cap::DOUBLE ELSE lvl * w END AS target FROM l, f),
q AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::DOUBLE - d.size::DOUBLE / 2 AS mid
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), m AS (
  SELECT doc_id, source, size, p, (mid + (p * source_size)::DOUBLE) / target AS t FROM q, range(3) r(p) WHERE size > 0
), c AS (
  SELECT *, (sum(size) OVER (ORDER BY t, source NULLS LAST, doc_id NULLS FIRST, p ROWS UNBOUNDED PRECEDING))::DOUBLE - size::DOUBLE / 2 AS mine FROM m
), b AS (SELECT sum(source_size)::DOUBLE AS budget FROM s),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c, b WHERE mine <= budget GROUP BY 1)
SELECT q.doc_id, q.size, q.source_size, coalesce(q.target, 0) AS target, coalesce(t.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN t ON q.doc_id IS NOT DISTINCT FROM t.doc_id
"""


def _found(kind: int, pattern: str, value_group: int, least: int) -> str:
    """Matches of one kind: the text before each and the match itself, whose lengths add up to places."""
    quoted = pattern.replace("'", "''")
    whole = f"(?s)(.*?)({quoted})"
    return f"""
      SELECT r, doc_id, source, lang, {kind} AS kind, unnest(list_zip(pre, m, v, range(1, len(m) + 1))) AS z, pre, m FROM (
        SELECT r, doc_id, source, lang, regexp_extract_all(t, '{whole}', 1) AS pre, regexp_extract_all(t, '{whole}', 2) AS m, regexp_extract_all(t, '{whole}', {value_group}) AS v
        FROM d WHERE regexp_matches(t, '{quoted}'))"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
raw AS ({_found(0, _ASSIGN, 4, 12)} UNION ALL {_found(1, "AKIA[A-Z0-9]+", 2, 18)} UNION ALL {_found(2, "[0-9a-f]+", 2, 16)} UNION ALL {_found(3, "[A-Za-z0-9+_=-]+", 2, 20)}),
p AS (
  SELECT r, source, lang, kind, z[3] AS v,
         (coalesce(list_sum(list_transform(pre[:z[4]], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:z[4] - 1], lambda x: length(x))), 0))::BIGINT AS s, length(z[2]) AS n
  FROM raw WHERE length(z[3]) >= [12, 18, 16, 20][kind + 1]
), b AS (SELECT r, source, lang, kind, v, s, s + n AS e FROM p WHERE kind < 3 OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]'))),
c AS (SELECT * FROM b WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM b AS o WHERE o.r = b.r AND o.kind < 3 AND o.s < b.e AND b.s < o.e)),
f AS (
  SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (coalesce(source, chr(1)), coalesce(lang, chr(1)))) AS repositories, max(kind = 0) AS assigned FROM c GROUP BY v
),
j AS (SELECT * FROM (SELECT c.*, owners, repositories, owners <= 1 AND repositories <= 2 AS live, assigned FROM c JOIN f USING (v)) WHERE kind < 3 OR live OR assigned),
x AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
         count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_example,
         max(owners) AS max_owners, max(repositories) AS max_repositories
  FROM j GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories
FROM d LEFT JOIN x USING (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASE_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PHRASES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PHRASE_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_PHRASE_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i:i + least(13, len(w)) - 1])) AS g FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
h AS (SELECT r, n, i, item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) JOIN (SELECT item_id, n, array_to_string(g, ' ') AS g FROM bw) USING (n, g)),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
q AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY 1),
-- proximity: each place of a window's rarest word (by documents that have it; ties: the first), and every other word within 3 of its own place as seen from there
o AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS MATERIALIZED (SELECT word, count(DISTINCT r) AS n_docs FROM o SEMI JOIN (SELECT unnest(w) AS word FROM b) USING (word) GROUP BY 1),
l AS MATERIALIZED (SELECT r, word, list(i) AS places FROM o SEMI JOIN f USING (word) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT row_number() OVER () AS id, item_id, n, g FROM (SELECT DISTINCT * FROM bw)),
x AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_docs, j) AS rarity
  FROM (SELECT id, item_id, n, unnest(g) AS word, unnest(range(1, n + 1)) AS j FROM g) JOIN f USING (word)
),
whole AS (SELECT id FROM x GROUP BY id HAVING count(*) = any_value(n)),
c1 AS (SELECT x.id, x.item_id, x.n, o.r, o.i - x.j AS origin FROM x SEMI JOIN whole USING (id) JOIN o USING (word) WHERE x.rarity = 1),
c2 AS MATERIALIZED (
  SELECT c1.* FROM c1 WHERE n = 1
  UNION ALL SELECT c1.* FROM c1 JOIN x ON x.id = c1.id AND x.rarity = 2 JOIN l ON l.r = c1.r AND l.word = x.word WHERE len(list_filter(places, lambda v: abs(v - origin - j) <= 3)) > 0
),
c3 AS (
  SELECT c2.item_id, c2.r, c2.n, c2.id, c2.origin FROM c2 JOIN x ON x.id = c2.id JOIN l ON l.r = c2.r AND l.word = x.word
  WHERE x.rarity = 1 OR len(list_filter(places, lambda v: abs(v - origin - j) <= 3)) > 0 GROUP BY ALL HAVING count(*) = c2.n
),
near AS (SELECT r, count(DISTINCT item_id) AS n_near_items FROM c3 GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r) LEFT JOIN near USING (r)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM e2 UNION SELECT e2.b, reach.seen FROM reach JOIN e2 ON reach.node = e2.a),
m AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM s LEFT JOIN m ON doc_id = node
"""


def _or_less(*states: str) -> str:
    return f"least({', '.join(states)})"


def _cost(state: str, cost: str, letter: str) -> str:
    """A state is its cost, padded, and the edits that follow: the least string is the cheapest, then the ASCII-least."""
    return f"(lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({state}, 10))"


def _repair() -> str:
    """The edit automaton as a recursion from the last row to the first, with all edits kept as strings."""
    goes, cut = "x.symbol = 8", "(CASE WHEN x.symbol >= 4 THEN 3 ELSE 0 END)"
    nexts, keeps = ("v2", "v2", "v3", "v2"), {0: {0: "v1", 1: "v2"}, 1: {1: "v2"}, 2: {2: "v3"}, 3: {1: "v2"}}
    w = []
    for q in range(4):
        keep = " ".join(f"WHEN x.symbol % 4 = {kind} THEN {_cost('d.' + to, cut, 'K')}" for kind, to in keeps[q].items())
        rest = _or_less(_cost(f"d.v{q}", "4", "D"), _cost("d." + nexts[q], "3 + " + cut, "R"), f"coalesce(CASE {keep} END, '~')")
        w.append(f"CASE WHEN {goes} THEN {_cost(f'd.v{q}', '4', 'D')} ELSE {rest} END AS w{q}")
    two = _or_less("w2", _cost("w3", "3", "I"))
    closed = [_or_less("w0", _cost(two, "3", "I")), _or_less("w1", _cost(two, "3", "I")), two, _or_less("w3", _cost("w2", "3", "I"))]
    sp = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    crc = "crc"
    return rf"""
WITH RECURSIVE bits(k, c) AS (
  SELECT i, i::BIGINT FROM range(256) t(i)
), crc_table AS (
  SELECT list(v ORDER BY k) AS tab FROM (
    SELECT k, list_reduce([c] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM bits)
), keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT keyed.*, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
    lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8))) % 20 AS {crc} FROM keyed, crc_table
), hurt AS (
  SELECT conv_id, turn, CASE WHEN {crc} = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE {crc} WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN {crc} = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE {crc} <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS pos, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before FROM hurt
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, rtrim(text, {sp}) AS bare FROM placed
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind FROM seen
), x AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 8 WHEN fault = 'truncated' THEN kind + 4 ELSE kind END AS symbol FROM faulty
), facts AS (
  SELECT conv_id, greatest(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM x GROUP BY conv_id
), d(conv_id, pos, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, '000000000', '000000006II', '000000003I', '000000000' FROM facts
  UNION ALL
  SELECT conv_id, pos, {closed[0]}, {closed[1]}, {closed[2]}, {closed[3]} FROM (
    SELECT x.conv_id, x.pos, {', '.join(w)} FROM d JOIN x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.pos = d.pos - 1)
), best AS (
  SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM d WHERE pos = 1
), letters AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, audit FROM best
), steps AS (
  SELECT conv_id, k, audit[k] AS letter, count_if(audit[k] <> 'I') OVER w AS pos, count_if(audit[k] <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), made AS (
  SELECT s.conv_id, s.k, s.letter, s.place, x.role, x.text, max(s.letter = 'K' AND s.place = 1 AND x.kind = 0) OVER (PARTITION BY s.conv_id) AS lead
  FROM steps s LEFT JOIN x ON s.letter <> 'I' AND x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.pos = s.pos
), joined AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN lead THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM made WHERE letter <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM o.conv_id"""


REPAIR = _repair()

#: The reputation of hosts as in hosts.py, with three levels one by one.
URLS = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(site, start, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), r AS (
  SELECT u.*, (SELECT max_by(site || start || ' ' || v, length(site || start)) FROM rules WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)) AS hit FROM u
), j AS (
  SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, split_part(hit, ' ', 2) AS v FROM r
), named AS (
  SELECT *, split_part(host, '.', -1) AS last, array_to_string(string_split(host, '.')[-2:], '.') AS last2, array_to_string(string_split(host, '.')[-3:], '.') AS last3 FROM (SELECT DISTINCT host FROM u)
), h AS (
  SELECT host, CASE WHEN listed THEN last2 ELSE last END AS suffix, CASE WHEN listed THEN last3 ELSE last2 END AS domain FROM (
    SELECT *, last2 IN ('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'org.au', 'org.uk') AS listed FROM named)
), bh AS (
  SELECT host, domain, suffix, count_if(v = 'block')::DOUBLE AS k, count(*)::DOUBLE AS n FROM j JOIN h USING (host) WHERE v IS NOT NULL GROUP BY 1, 2, 3
), bd AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM bh GROUP BY 1, 2
), bs AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM bd GROUP BY 1
), ba AS (SELECT coalesce(sum(k), 0) AS k, coalesce(sum(n), 0) AS n FROM bs
), level(name, ck, cn, pk, pn) AS (
  SELECT 's', bs.k, bs.n, ba.k, ba.n FROM bs, ba UNION ALL SELECT 'd', bd.k, bd.n, bs.k, bs.n FROM bd JOIN bs USING (suffix) UNION ALL SELECT 'h', bh.k, bh.n, bd.k, bd.n FROM bh JOIN bd USING (domain)
), rho AS (
  SELECT name, least(0.9, greatest(0.001, CASE WHEN sum(e * (cn - 1)) > 0 THEN (sum(cn * pow(ck / cn - pk / pn, 2)) - sum(e)) / sum(e * (cn - 1)) ELSE 0.001 END)) AS r
  FROM (SELECT *, pk / pn * (1 - pk / pn) AS e FROM level) GROUP BY name
), c AS (
  SELECT coalesce(max(CASE WHEN name = 's' THEN (1 - r) / r END), 1) AS cs, coalesce(max(CASE WHEN name = 'd' THEN (1 - r) / r END), 1) AS cd, coalesce(max(CASE WHEN name = 'h' THEN (1 - r) / r END), 1) AS ch FROM rho
), m AS (
  SELECT h.host, (coalesce(bh.k, 0) + ch * (coalesce(bd.k, 0) + cd * (coalesce(bs.k, 0) + cs * (ba.k + 0.5) / (ba.n + 1)) / (coalesce(bs.n, 0) + cs)) / (coalesce(bd.n, 0) + cd)) / (coalesce(bh.n, 0) + ch) AS m, coalesce(bh.n, 0) + ch AS size
  FROM h CROSS JOIN c CROSS JOIN ba LEFT JOIN bs USING (suffix) LEFT JOIN bd ON bd.domain = h.domain LEFT JOIN bh ON bh.host = h.host
)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN m.m - 1.645 * sqrt(m.m * (1 - m.m) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN m ON m.host = j.host"""

#: Frequent sets by growing them with the baskets that hold each; closed ones have no larger set with as many baskets.
BASKETS = r"""
WITH RECURSIVE b AS (
  SELECT DISTINCT sale_id AS s, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL
), total AS (SELECT count(DISTINCT s) AS b FROM b
), one AS (
  SELECT i, list(s) AS held, count(*) AS n FROM b GROUP BY i HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT b FROM total)
), kept AS (SELECT s, i FROM b WHERE i IN (SELECT i FROM one)
), pair AS (
  SELECT x.i AS a, y.i AS b FROM kept x JOIN kept y ON x.s = y.s AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT b FROM total)
), sets(items, last, held, n) AS (
  SELECT [i], i, held, n FROM one
  UNION ALL
  SELECT items, last, held, len(held) FROM (
    SELECT list_append(sets.items, pair.b) AS items, pair.b AS last, list_intersect(sets.held, one.held) AS held FROM sets JOIN pair ON pair.a = sets.last JOIN one ON one.i = pair.b)
  WHERE len(held) >= 5 AND len(held) * 20000 >= (SELECT b FROM total)
), parts AS (
  SELECT items, n, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, n, unnest(items) AS c FROM sets)
), closed AS (
  SELECT items, n FROM sets WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.rest = sets.items AND parts.n = sets.n)
), rules AS (
  SELECT p.items, p.c, r.n AS a, o.n AS s FROM parts p JOIN closed USING (items) JOIN sets r ON r.items = p.rest JOIN one o ON o.i = p.c
  WHERE 100 * p.n >= 60 * r.n AND p.n * (SELECT b FROM total) > r.n * o.n
), listed AS (
  SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text FROM rules GROUP BY items
)
SELECT array_to_string(items, ',') AS items, len(items)::BIGINT AS n_items, n::BIGINT AS support, coalesce(n_rules, 0)::BIGINT AS n_rules, best_item, sha256(coalesce(text, '')) AS rules_sha256
FROM closed LEFT JOIN listed USING (items)"""
