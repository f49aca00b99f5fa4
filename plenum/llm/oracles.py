"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# Exhaustive search: same products, summed in the same precision, as the reranking.
NEAREST = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS place
  FROM s
), t AS (
  SELECT source, source_size,
    least(most, coalesce(arg_min(level, CASE WHEN level * w <= most THEN place END) OVER () * w, most)) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS full_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(full_ * size + greatest(0, least(size, floor(target) - full_ * source_size - start)) AS BIGINT) AS taken
FROM r
"""

# CRC-32 bit by bit: the polynomial 0xEDB88320 (3988292384) and the final complement are the standard's.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY p) AS turns, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t GROUP BY conv_id
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), pre AS (
  SELECT conv_id, d AS depth, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)) AS k,
    CASE WHEN d > 0 THEN sha256(CAST(to_json(turns[1:d - 1]) AS VARCHAR)) END AS up,
    CASE WHEN d > 0 THEN CAST(len(regexp_extract_all(turns[d].x, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) ELSE 0 END AS words, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), node AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, min(up) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM pre GROUP BY depth, k
), child AS (SELECT depth - 1 AS depth, up, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.depth = n.depth AND c.up = n.k),
below AS (
  SELECT p.depth, p.k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
  FROM full_ n JOIN pre p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_ f JOIN below b ON b.depth = f.depth AND b.k = f.k LEFT JOIN node u ON u.depth = f.depth - 1 AND u.k = f.up
"""

RESAMPLING = f"""
WITH w AS (
  SELECT true AS own, rid, doc_id, ws FROM (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents)
  UNION ALL SELECT false, 0, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), f AS (
  SELECT own, rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w
), n AS (SELECT own, rid, feature, count(*) AS n FROM f GROUP BY ALL),
b AS MATERIALIZED (SELECT feature, {CRC32.format("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n)),
m AS (SELECT own, rid, bucket, CAST(sum(n) AS BIGINT) AS n FROM n JOIN b USING (feature) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM m GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s),
d AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM m JOIN g USING (bucket) WHERE own GROUP BY rid
), scored AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN d ON d.rid = w.rid WHERE own
), c AS (
  SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS fit
  FROM c
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM r
"""

SHINGLES = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS items FROM w
), e AS MATERIALIZED (SELECT rid, len(items) AS n, unnest(items) AS item FROM s),
df AS (SELECT item, count(*) AS df FROM e GROUP BY item),
-- Two sets alike at 90 % share one of the rarest tenth of either.
o AS MATERIALIZED (SELECT rid, n, item, row_number() OVER (PARTITION BY rid ORDER BY df, item) AS place FROM e JOIN df USING (item)),
c AS (
  SELECT DISTINCT a.rid AS a, b.rid AS b FROM o a JOIN o b ON a.item = b.item AND a.rid < b.rid
  WHERE a.place <= a.n - (9 * a.n + 9) // 10 + 1 AND b.place <= b.n - (9 * b.n + 9) // 10 + 1 AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
), l AS (
  SELECT c.a, c.b FROM c JOIN e x ON x.rid = c.a JOIN e y ON y.rid = c.b AND y.item = x.item
  GROUP BY c.a, c.b, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
least_ AS (SELECT r.a, min(s.doc_id) AS component_id FROM reach r JOIN s ON s.rid = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, component_id FROM s JOIN least_ ON least_.a = s.rid
"""

# The query reranks 640 classes of a block, so on a table of no more vectors it is exhaustive itself.
ORACLES = {"op3_additive_search": NEAREST, "op5_mixing": MIXING, "op11_prefix_trie": TRIE, "op12_target_sampling": RESAMPLING, "op13_shingle_join": SHINGLES}
