"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_QUINT = [f"CAST('0x' || substr(hexed, {5 * i + 1}, 5) AS INTEGER)" for i in range(8)]
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({q} >> {s}) & 31) + 1, 1)" for q in _QUINT for s in (15, 10, 5, 0))

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, hexed, max(page_id) OVER (PARTITION BY hexed) AS last_id FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM d
"""

OP4 = """
WITH sized AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS order_key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM src),
leveled AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0::DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
targeted AS (
  SELECT *, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target
  FROM leveled),
plan AS (
  SELECT *, least(CAST(floor(target) AS BIGINT), cap) AS wanted,
    CASE WHEN source_size > 0 THEN least(CAST(floor(target) AS BIGINT), cap) // source_size ELSE 0 END AS full_epochs
  FROM targeted),
placed AS (
  SELECT s.row_no, s.doc_id, s.size, p.source_size, p.target, p.full_epochs, p.wanted - p.full_epochs * p.source_size AS rest,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.order_key, s.doc_id, s.size, s.row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begin_at
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(full_epochs * size + greatest(0, least(begin_at + size, rest) - begin_at) AS BIGINT) AS taken
FROM placed
"""

OP8 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT row_no, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n)),
hits AS (
  SELECT d.row_no, d.i, d.n, x.item FROM doc_windows d JOIN item_windows x ON d.g = x.g AND d.n = x.n),
hit_words AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row_no),
hit_items AS (
  SELECT row_no, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)
"""

OP9 = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
judged AS (
  SELECT u.*, (SELECT max_by(rule_host || rule_path || ' ' || rule_verdict, length(rule_host || rule_path)) FROM rules
    WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)) AS best
  FROM u)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, coalesce(split_part(best, ' ', 2), 'allow') AS verdict FROM judged
"""

OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least_id THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x)
    JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
named AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM steps),
kinds AS (SELECT part, failed, good, toxic, count(*) AS n FROM f GROUP BY ALL),
told AS (
  SELECT k.*, s.*, contains(k.failed, s.x) AS fails, len(k.failed) > 0 AND len(translate(k.failed, s.earlier, '')) < len(k.failed) AS gone
  FROM kinds k, named s),
counted AS (
  SELECT part, filter_order, step, x,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, x)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLES = {
    "op1_warc_index": OP1,
    "op4_mix_sources": OP4,
    "op8_decontaminate": OP8,
    "op9_url_filter": OP9,
    "op11_filter_audit": OP11,
    "op13_hard_negatives": OP13,
}
