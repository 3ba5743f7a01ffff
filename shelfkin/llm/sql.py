"""SQL counterparts of the registered queries that SQL can express, written from the contracts."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), cut AS (
  SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '[\t-\r ]+'), lambda w: w <> '') AS bare FROM lines
), words AS (
  SELECT doc_id, pos, line,
    CASE WHEN len(bare) < 5 THEN bare
    ELSE list_transform(bare, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) END AS w
  FROM cut
), branches AS (
  SELECT doc_id, pos, w, len(w) AS n, unnest(range(-1, 8)) AS k FROM words WHERE len(w) >= 1
), cuts AS (
  SELECT *, 3 + (n - 3) * k // 8 AS a, 3 + (n - 3) * (k + 1) // 8 AS b FROM branches WHERE k = -1 OR n >= 8
), templates AS (
  SELECT doc_id, pos, w, n, k,
    CASE WHEN k = -1 THEN w ELSE list_concat(list_concat(w[1:a], ['<gap>']), w[b + 1:]) END AS t
  FROM cuts WHERE k = -1 OR b > a
), recurring AS (
  SELECT n, k, t, min(doc_id) AS first FROM templates GROUP BY n, k, t HAVING min(doc_id) <> max(doc_id)
), starts AS (
  SELECT w, min(first) AS first FROM templates JOIN recurring USING (n, k, t) GROUP BY w
), marked AS (
  SELECT words.doc_id, words.pos, line, coalesce(words.doc_id > first, false) AS dropped
  FROM words LEFT JOIN starts ON starts.w = words.w AND len(words.w) >= 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

URLS = r"""
WITH rules (host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT page_id, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(r.verdict, len(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

# The table of the cyclic redundancy check comes from its polynomial, bit by bit.
IMPORTANCE = r"""
WITH RECURSIVE bits (i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS cell FROM bits WHERE k = 8
), texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), text FROM benchmark
), found AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), counted AS (
  SELECT side, id, word, count(*) AS n FROM found GROUP BY ALL
), cells AS (
  SELECT word, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(strlen(word)), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, cell[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), crc
), sides AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM range(10000) b(bucket) LEFT JOIN cells USING (bucket) LEFT JOIN counted USING (word) GROUP BY b.bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sides) + 10000))))::BIGINT AS gain
  FROM sides
), weighed AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN cells USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""

FILTER_AUDIT = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM words
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM masks LEFT JOIN labels USING (doc_id) GROUP BY ALL
), letters (letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, bit, coalesce((SELECT sum(x.bit)
    FROM letters x WHERE instr(filter_order, x.letter) < step), 0)::INTEGER AS before
  FROM orders, range(1, 6) s(step), letters WHERE filter_order[step] = letter
), result AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM result
"""
