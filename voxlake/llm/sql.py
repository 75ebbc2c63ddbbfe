"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) >= 8),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j)::BIGINT AS n FROM rep, unnest(range(0, 8)) u(j) GROUP BY rid),
ln AS (SELECT rid, source, text, line, {WORDS.replace("coalesce(text, '')", 'line')} AS lw FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT rid, source, text, line, lower(array_to_string(lw, ' ')) AS norm, len(lw) AS n FROM ln WHERE len(lw) > 0),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
freq AS (SELECT l.source, l.norm FROM lines l GROUP BY l.source, l.norm HAVING count(DISTINCT l.text) > least(1000, greatest(10, 0.02 * (SELECT any_value(h.docs) FROM hosts h WHERE h.source IS NOT DISTINCT FROM l.source)))),
gone AS (SELECT l.rid, sum(l.n)::BIGINT AS n, count(DISTINCT l.norm)::BIGINT AS k FROM lines l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.rid),
b AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
j AS (SELECT b.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, (b.n_words - coalesce(gone.n, 0))::BIGINT AS n_words_left, coalesce(gone.k, 0)::BIGINT AS n_frequent_lines
  FROM b LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT n_words_left < 0.2 * n_words AS kept, n_words_left, n_frequent_lines FROM v
"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) u(i) WHERE len(w) >= 35),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + j AS p FROM rep, unnest(range(0, 35)) u(j)),
ww AS (SELECT d.rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) u(p)),
k AS (SELECT ww.rid, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY ww.p) AS kept FROM ww LEFT JOIN gone ON ww.rid = gone.rid AND ww.p = gone.p GROUP BY ww.rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT rid, hash(array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ')) AS s FROM d, unnest(range(1, greatest(2, len(w) - 1))) u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid AS a, rid AS z FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.z GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS n_tokens, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS rank FROM documents),
t AS (SELECT source AS s, sum(n_tokens)::BIGINT AS t, count(*) AS n FROM d GROUP BY source),
e AS (SELECT max(t)::DOUBLE AS top, greatest(0, 1 - ln(1.1::DOUBLE) / nullif(ln(max(t)::DOUBLE / min(t)), 0)) AS a FROM t WHERE t > 0),
w AS (SELECT s, t, n, exp(coalesce(a, 0) * ln(t / top)) AS w, top FROM t, e WHERE t > 0),
p AS (SELECT s, w / sum(w) OVER () AS weight, floor(top * w * (1 + 1e-12::DOUBLE) + 1e-6)::BIGINT AS draw, t FROM w),
q AS (SELECT t.s, coalesce(p.weight, 0) AS weight, coalesce(p.draw // p.t, 1) AS epochs, coalesce(p.draw % p.t, 0) AS rest, ceil(t.n / 4096.0)::BIGINT AS blocks FROM t LEFT JOIN p ON t.s IS NOT DISTINCT FROM p.s),
x AS (SELECT d.*, q.weight, q.epochs, q.rest, rank % blocks AS b, ('0x' || substr(md5('8:' || coalesce(source, '') || ':' || (rank % blocks)), 1, 15))::BIGINT AS place FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.s),
bl AS (SELECT source, b, place, any_value(rest) AS rest, sum(n_tokens) AS tokens FROM x GROUP BY source, b, place),
bb AS (SELECT source, b, rest, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY place, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl),
y AS (SELECT x.*, bb.before, bb.tokens, sum(n_tokens) OVER (PARTITION BY x.source, x.b ORDER BY rank, n_tokens RANGE UNBOUNDED PRECEDING) AS run FROM x JOIN bb ON x.source IS NOT DISTINCT FROM bb.source AND x.b = bb.b)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, (epochs + CASE WHEN rest > 0 AND (before + tokens <= rest OR before + run <= rest) THEN 1 ELSE 0 END)::BIGINT AS copies FROM y
"""

#: levenshtein() counts bytes, so each letter beyond ASCII stands as one byte that folded text doesn't hold; more letters than such bytes are an error.
LINES = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
u AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM d WHERE text IS NOT NULL),
f AS (SELECT *, lower(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' ')) AS s FROM u),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS more FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM (SELECT lower(text) AS text FROM d))),
k AS (SELECT s, row_number() OVER (ORDER BY s) AS i, length(s) AS n, CASE WHEN length(more) > 26 THEN error('more than 26 letters beyond ASCII') ELSE translate(s, more, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[:length(more)]) END AS z
  FROM (SELECT DISTINCT s FROM f WHERE s <> '') CROSS JOIN m),
p AS (SELECT a.i AS x, b.i AS y FROM k a JOIN k b ON b.n BETWEEN a.n AND a.n + 2 AND (b.n > a.n OR a.i < b.i) AND a.n >= 12
  WHERE (contains(b.z, a.z[1:a.n // 3]) OR contains(b.z, a.z[a.n // 3 + 1:2 * (a.n // 3)]) OR contains(b.z, a.z[2 * (a.n // 3) + 1:])) AND levenshtein(a.z, b.z) <= least(2, a.n // 12)),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT DISTINCT x AS a, x AS z FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z),
c AS (SELECT a AS i, min(z) AS c FROM r GROUP BY a),
o AS (SELECT f.*, coalesce(c.c, k.i) AS c FROM f LEFT JOIN k ON k.s = f.s LEFT JOIN c ON c.i = k.i),
g AS (SELECT *, s <> '' AND row_number() OVER (PARTITION BY c ORDER BY doc_id, no) > 1 AS gone FROM o),
t AS (SELECT rid, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY rid)
SELECT doc_id, (CASE WHEN coalesce(kept, '') = '' THEN 0 ELSE len(string_split(kept, chr(10))) END + coalesce(n, 0))::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (rid)
"""

#: Every kept term of a language for each of its sources, zeros included.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM x WHERE n > 0 AND p > q),
z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
"""

SQL = {"op4_line_dedup": LINES, "op9_mixing": MIX, "op6_substring_dedup": REPEATS, "op7_minhash_near_dedup": NEAR, "op8_exact_top_k": TOP_K, "op10_quality_rules": QUALITY, "op12_source_divergence": DIVERGENCE}
