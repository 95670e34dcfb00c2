"""SQL, for DuckDB, that gives the rows of the registered queries where SQL can express them."""

OP3 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.r, c.r AS cr, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r != c.r AND q.vec_id % 20 = 0 AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP7 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

#: Expects a view ``docs_to_mix`` (doc_id, text, source).
MIX = r"""
sized AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM docs_to_mix
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), ordered AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS k FROM weighted
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ordered
), chosen AS (
  SELECT level FROM levels WHERE cap > weight * level ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * (SELECT level FROM chosen) THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM chosen) END AS target,
         CASE WHEN cap <= weight * (SELECT level FROM chosen) THEN 3
              WHEN source_size > 0 THEN CAST(floor(weight * (SELECT level FROM chosen) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM ordered
), running AS (
  SELECT s.*, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id) AS upto,
         sum(size) OVER (PARTITION BY s.source, place, doc_id) AS own
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
         whole + CASE WHEN rest > 0 AND 2 * upto - own <= 2 * rest THEN 1 ELSE 0 END AS copies
  FROM running
)
"""

OP8 = "WITH docs_to_mix AS (SELECT * FROM documents), " + MIX + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"

OP13 = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), numbers AS (
  SELECT doc_id, text, n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM h
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substring(text, 1, c1) AS prefix, substring(text, c1 + 1, c2 - c1) AS middle, substring(text, c2 + 1) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN c1 END AS prefix_chars, CASE WHEN form != 'plain' THEN c2 - c1 END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
