"""DuckDB SQL that states the results of the queries which SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 2 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
  FROM per
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM weighed
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), fit AS (
  SELECT k AS first_k, level AS first_level FROM levels WHERE level * w <= cap ORDER BY k LIMIT 1
), target AS (
  SELECT source, source_size, CASE WHEN k >= first_k THEN first_level * w ELSE cap END AS target
  FROM levels LEFT JOIN fit ON true
), copies AS (
  SELECT s.*, t.source_size, t.target, r.round, (t.source_size * r.round + sum(s.size) OVER (
           PARTITION BY s.source, r.round ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / nullif(t.target, 0) AS v
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS round) r
), taken AS (
  SELECT *, sum(size) OVER (ORDER BY v, key, doc_id NULLS FIRST, round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1.5 * (SELECT sum(size) FROM sized) AS yes
  FROM copies
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN yes THEN size ELSE 0 END) AS BIGINT) AS taken
FROM taken GROUP BY row, doc_id, size, source_size, target
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT *, md5(line) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines
), marked AS (
  SELECT *, words >= 50 OR coalesce(lead(words) OVER d, 50) >= 50 OR substr(md5(coalesce(lag(h) OVER d, '') || h), 1, 1) < '8' AS ends
  FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM marked
), chunks AS (
  SELECT doc_id, chunk, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS bytes,
         max(words) >= 50 OR count(*) FILTER (words > 0) >= 2 AS counts
  FROM numbered GROUP BY doc_id, chunk
), gone AS (
  SELECT doc_id, chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id NULLS LAST, first) AS k FROM chunks WHERE counts) WHERE k > 1
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (g.chunk IS NULL) AS text, count(g.chunk) AS removed
  FROM numbered n LEFT JOIN gone g USING (doc_id, chunk) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.removed, 0) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

NEAREST = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.e, d.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, d.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id, e ORDER BY score, vec_id) QUALIFY rank <= 10
"""

HIGHEST = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.e, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id, e ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

NEGATIVES = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label, a.e, d.vec_id, d.label AS other,
         CAST(list_sum(list_transform(list_zip(a.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.e) = len(d.e) WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, label, e, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS nth FROM pairs WHERE label = other
  WINDOW w AS (PARTITION BY anchor_id, label, e ORDER BY score DESC, vec_id) QUALIFY nth <= 5
), found AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score
  FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label = p.label AND n.e = p.e AND n.other <> p.label
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, negative_id, positive_score, negative_score FROM found
WINDOW w AS (PARTITION BY anchor_id, label, e, nth ORDER BY negative_score DESC, negative_id) QUALIFY rank <= 3
"""

LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS w
  FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) AS r(i) WHERE len(ws) > 0
), inside AS (
  SELECT row, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, greatest(len(ws) - n + 2, 1))) AS r(i)
), hits AS (
  SELECT row, i, n, item FROM inside JOIN windows USING (n, w)
), words AS (
  SELECT row, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits WHERE item IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

#: DuckDB has no CRC-32: it is made from its definition, bit by bit, for every id.
PREFIXES = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 1 AS k, CAST(4294967295 AS BIGINT) AS r FROM said
  UNION ALL
  SELECT conv_id, s, k + 1, list_reduce([xor(r, CAST(ascii(s[k]) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) FROM crc WHERE k <= length(s)
), convs AS (
  SELECT conv_id, xor(r, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE k > length(s)
), rebuilt AS (
  SELECT s.conv_id, s.pos, digest, words FROM said s JOIN convs USING (conv_id) WHERE s.pos > h
  UNION ALL
  SELECT c.conv_id, s.pos, digest, words FROM convs c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 20 WHERE s.pos <= h
), paths AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY pos) FILTER (digest IS NOT NULL), []) AS path, coalesce(list(words ORDER BY pos) FILTER (digest IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), members AS (
  SELECT conv_id, path[1:d] AS prefix, d AS depth, len(path) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM paths, unnest(range(0, len(path) + 1)) AS r(d)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY prefix, depth
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT n.prefix[1:d] AS prefix, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (prefix), unnest(range(0, n.depth + 1)) AS r(d) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM words, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)
), reached AS (
  SELECT doc_id, doc_id AS label FROM words UNION SELECT l.y, r.label FROM reached r JOIN links l ON l.x = r.doc_id
)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.label) AS component_id, w.doc_id = min(r.label) AS kept
FROM words w JOIN reached r ON r.doc_id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""

#: The given pages mark the article and use paragraphs, headings and few character references.
PAGES = r"""
WITH article AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?(?:p|h1|li|ul|div)(?: [^>]*)?>') AS parts FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
  ), lambda x: x <> '') AS blocks FROM article
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM blocks
"""
