"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
lines AS (SELECT rid, doc_id, source, th, len(lw) AS lw, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
    FROM (SELECT rid, doc_id, source, md5(t) AS th, regexp_extract_all(unnest(ls), '[^\x20\x09-\x0D]+') AS lw FROM w)),
common AS (SELECT source, norm FROM lines GROUP BY ALL HAVING count(DISTINCT th) > 10),
held AS (SELECT l.*, first_value(doc_id) OVER w AS own_id, first_value(th) OVER w AS own_th FROM lines l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source WINDOW w AS (PARTITION BY l.source, l.norm ORDER BY l.doc_id NULLS LAST, l.th)),
gone AS (SELECT rid, sum(lw) AS n FROM held WHERE NOT (doc_id IS NOT DISTINCT FROM own_id AND th = own_th) GROUP BY 1),
base AS (SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words FROM w LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AND n_words - removed_words >= 50 AS kept, removed_words::BIGINT AS removed_words FROM base
"""

MIXING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY (sk = ''), sk) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER o AS k, (SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, sk)),
c AS (SELECT k, rest::DOUBLE / ws AS share FROM r WHERE rest::DOUBLE / ws * w <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT r.sk, source_size, CASE WHEN r.k < c.k THEN (3 * source_size)::DOUBLE ELSE share * w END AS target FROM r, c),
p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.sk ORDER BY key, rid ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON t.sk = d.sk),
q AS (SELECT p.*, pass, (pass * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1), (2)) AS x(pass) WHERE size > 0 AND target > 0),
g AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, sk, key, rid ROWS UNBOUNDED PRECEDING) AS run FROM q),
k AS (SELECT rid, count(*) AS copies, sum(size) AS taken FROM g WHERE run <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(copies, 0) AS copies FROM p LEFT JOIN k USING (rid)
"""

LEXICAL_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t, s.n),
x AS (SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * tf.n * s.n) // s.l)))) AS x FROM tf JOIN w USING (t), s),
r AS (SELECT item_id, rid, doc_id, sum(x)::BIGINT AS score FROM i JOIN x USING (t) GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r QUALIFY rank <= 10
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, t, count(*) AS c, count(DISTINCT rid) AS df FROM (SELECT rid, lang, source, unnest(ts) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, sum(c)::BIGINT AS c FROM o GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM k GROUP BY 1),
kc AS (SELECT o.lang, o.source, o.t, o.c FROM o JOIN k USING (lang, t)),
n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM kc GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(kc.c, 0) AS c, 1 + (1000000000 * (coalesce(kc.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p, 1 + (1000000000 * (k.c + 2)) // (v.n + 2 * v.v) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN kc ON kc.lang = g.lang AND kc.source = g.source AND kc.t = k.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM t) QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES = {"op2_quality_rules": QUALITY_RULES, "op9_mixing": MIXING, "op11_lexical_search": LEXICAL_SEARCH, "op13_divergence": DIVERGENCE}
