"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
items AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS pat
  FROM items, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS t(i) WHERE len(ws) > 0
),
wins AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS pat
  FROM docs, (SELECT DISTINCT k FROM pats) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(i)
),
hits AS (SELECT rid, i, wins.k, item_id FROM wins JOIN pats USING (k, pat)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) AS h GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) AS h GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


RULES = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM docs, unnest(range(1, len(ws) - 3)) AS t(i)),
again AS (SELECT rid, gram FROM grams GROUP BY rid, gram HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM grams JOIN again USING (rid, gram)) AS g GROUP BY rid),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(ls) AS n_lines, length(text) - length(translate(text, '!', '')) AS n_exclaim, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
         len(list_distinct(ws)) AS n_distinct
  FROM docs LEFT JOIN covered USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR 10 * n_exclaim > 5 * n_words OR 2 * n_capitals > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_words >= 50 AND 10 * n_distinct < n_words)) AS kept
FROM counted
"""

LINES = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(doc_id, 9223372036854775807) AS ord, concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(text)) AS doc, string_split(text, chr(10)) AS ls FROM documents),
split AS (
  SELECT rid, doc, ord, i, ls[i] AS raw, list_transform(regexp_extract_all(ls[i], '[^ \t\n\x0B\f\r]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
  FROM docs, unnest(range(1, len(ls) + 1)) AS t(i)
),
lines AS (SELECT *, len(toks) AS n, array_to_string(toks[1:3], ' ') AS head, array_to_string(toks, ' ') AS line, len(list_filter(toks, lambda t: t = '<*>')) AS fields FROM split WHERE len(toks) >= 1),
same AS (SELECT raw, min(ord) AS first FROM lines GROUP BY raw HAVING min(doc) <> max(doc)),
dist AS (SELECT n, head, line, any_value(fields) AS fields, any_value(toks) AS toks, min(doc) AS low, max(doc) AS high, min(ord) AS first FROM lines WHERE n >= 3 GROUP BY n, head, line),
leaves AS (SELECT n, head, count(*) AS m FROM dist GROUP BY n, head HAVING count(*) > 1 AND min(low) <> max(high)),
cells AS (SELECT dist.*, m, unnest(range(1, n + 1)) AS pos FROM dist JOIN leaves USING (n, head)),
const AS (SELECT n, head, pos, toks[pos] AS token, 2 * count(*) > max(m) AS common, min(low) <> max(high) AS supported FROM cells WHERE toks[pos] <> '<*>' GROUP BY n, head, pos, toks[pos] HAVING 2 * count(*) > max(m) OR min(low) <> max(high)),
known AS (
  SELECT c.n, c.head, c.line, min(c.low) AS low, max(c.high) AS high, min(c.first) AS first, c.n - max(c.fields) AS plain, count(*) FILTER (k.common) AS kept,
         coalesce(list(c.pos || ':' || k.token ORDER BY c.pos) FILTER (k.supported), []) AS held
  FROM cells AS c JOIN const AS k ON c.n = k.n AND c.head = k.head AND c.pos = k.pos AND c.toks[c.pos] = k.token GROUP BY c.n, c.head, c.line
),
shaped AS (SELECT * FROM known WHERE 100 * kept >= 80 * plain AND 2 * kept >= n),
shared AS (SELECT n, head, min(first) AS first FROM shaped GROUP BY n, head HAVING min(low) <> max(high)),
keys AS (
  SELECT n, head, line, low, high, first, array_to_string(held, ' ') AS key FROM known WHERE 100 * len(held) >= 80 * plain AND 2 * len(held) >= n
  UNION ALL SELECT n, head, line, low, high, first, array_to_string(list_filter(held, lambda h: h <> held[j]), ' ') AS key
  FROM known, unnest(range(1, len(held) + 1)) AS t(j) WHERE 100 * (len(held) - 1) >= 80 * plain AND 2 * (len(held) - 1) >= n
),
several AS (SELECT n, head, key, min(first) AS first FROM keys GROUP BY n, head, key HAVING min(low) <> max(high)),
gone AS (
  SELECT n, head, line, min(first) AS first FROM (
    SELECT n, head, line, first FROM dist WHERE low <> high AND 2 * (n - fields) >= n
    UNION ALL SELECT s.n, s.head, s.line, h.first FROM shaped AS s JOIN shared AS h ON s.n = h.n AND s.head = h.head
    UNION ALL SELECT k.n, k.head, k.line, s.first FROM keys AS k JOIN several AS s ON k.n = s.n AND k.head = s.head AND k.key = s.key
  ) AS u GROUP BY n, head, line
),
lost AS (
  SELECT rid, list(DISTINCT i) AS nos FROM (
    SELECT l.rid, l.i FROM lines AS l JOIN gone AS g ON l.n = g.n AND l.head = g.head AND l.line = g.line WHERE l.ord <> g.first
    UNION ALL SELECT l.rid, l.i FROM lines AS l JOIN same AS s ON l.raw = s.raw WHERE l.ord <> s.first AND (l.n < 3 OR 2 * (l.n - l.fields) < l.n)
  ) AS u GROUP BY rid
)
SELECT doc_id, new AS text, CAST(length(new) AS BIGINT) AS n_chars, n_lines, n_dropped FROM (
  SELECT doc_id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(nos, i)), lambda i: ls[i]), chr(10)) END AS new,
         CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(nos), 0) AS BIGINT) AS n_dropped
  FROM docs LEFT JOIN lost USING (rid)
) AS r
"""

NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN scores AS s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN label END AS label,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
),
links AS (SELECT a.rid, b.rid AS other FROM v AS a JOIN v AS b ON a.label = b.label AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.other FROM reach AS r JOIN links AS l ON r.other = l.rid),
least AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reach AS r JOIN v ON r.other = v.rid GROUP BY r.rid),
counts AS (SELECT rid, count(*) AS n FROM links GROUP BY rid)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (rid) LEFT JOIN counts USING (rid)
"""

RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, ws FROM (SELECT DISTINCT item_id, {WORDS} AS ws FROM benchmark) AS b),
stats AS (SELECT count(*) AS total, CAST(sum(len(ws)) AS BIGINT) AS length FROM docs WHERE len(ws) > 0),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM docs) AS d GROUP BY rid, term),
wanted AS (SELECT iid, term, count(*) AS c FROM (SELECT iid, unnest(ws) AS term FROM items) AS i GROUP BY iid, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, stats WHERE term IN (SELECT term FROM wanted) GROUP BY term, total),
scored AS (
  SELECT iid, d.rid, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * len(d.ws) * total) // length))))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN docs AS d ON d.rid = tfs.rid, stats GROUP BY iid, d.rid
)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scored JOIN items USING (iid) JOIN docs USING (rid) WHERE score > 0
WINDOW w AS (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER w <= 20
"""

ORACLES = {"op1_decontaminate": DECONTAMINATE, "op4_lines": LINES, "op8_rules": RULES, "op11_negatives": NEGATIVES, "op12_vectors": VECTORS, "op13_ranked": RANKED}
