"""DuckDB SQL of the queries that SQL can express, over the whole given tables."""

from __future__ import annotations

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = vec_id) AS BIGINT) AS n_links,
       least(vec_id, (SELECT min(b) FROM reach WHERE reach.a = vec_id)) AS component_id,
       vec_id = least(vec_id, (SELECT min(b) FROM reach WHERE reach.a = vec_id)) AS kept
FROM embeddings
"""

# CRC-32 byte by byte with the table of the reflected polynomial 0xEDB88320, built by its rule
SHARDING = """
WITH RECURSIVE steps AS (
  SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, text, CASE WHEN doc_id IS NULL THEN 'n' ELSE 'v' || doc_id END AS key,
         CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes
  FROM documents
), s AS (
  SELECT doc_id, size,
         CASE WHEN text IS NOT NULL THEN CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
           lambda a, x: xor(a >> 8, crc.t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) END AS text_crc32,
         list_transform(range(17), lambda i: -ln((('0x' || substr(md5(key || '#' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS cost
  FROM d, crc
), a AS (
  SELECT doc_id, size, text_crc32, CAST(list_position(cost[1:16], list_min(cost[1:16])) - 1 AS INTEGER) AS shard,
         CAST(list_position(cost, list_min(cost)) - 1 AS INTEGER) AS grown_shard
  FROM s
), k AS (
  SELECT *, substr(md5(concat_ws(':', CASE WHEN doc_id IS NULL THEN 'n' ELSE 'v' || doc_id END, 'v' || size,
         CASE WHEN text_crc32 IS NULL THEN 'n' ELSE 'v' || text_crc32 END, 'v' || grown_shard)), 1, 3) AS bucket FROM a
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket,
       doc_id NULLS FIRST, size, text_crc32 NULLS FIRST, grown_shard) - 1 AS BIGINT) AS slot, grown_shard
FROM k
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), grams AS (
  SELECT r, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)
), found AS (SELECT g.r, g.p, g.k, x.item_id FROM grams g JOIN wins x ON g.k = x.k AND g.win = x.win),
hits AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON d.r = h.r LEFT JOIN items i ON d.r = i.r
"""

# CRC-32 once for every distinct feature, by the same table as above
IMPORTANCE = f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT -row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
feats AS (
  SELECT r, array_to_string(list_slice(w, p, p + k - 1), ' ') AS f
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM (SELECT r, w FROM d UNION ALL SELECT r, w FROM b), range(1, 4) n(k) WHERE len(w) >= k)
), hashed AS (
  SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::UBIGINT)),
           lambda a, x: xor(a >> 8, crc.t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS INTEGER) AS bucket
  FROM (SELECT DISTINCT f FROM feats), crc
), placed AS (SELECT r, bucket FROM feats JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counts) + 10000) AS DOUBLE)
           / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM counts
), weights AS (SELECT r, count(*) AS n, sum(g) AS weight FROM placed JOIN gain USING (bucket) WHERE r > 0 GROUP BY r),
scores AS (
  SELECT d.r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights ON d.r = weights.r
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, (5 * count(*) OVER ()) // 100 AS k FROM scores WHERE words >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN rank <= k THEN rank END AS BIGINT) AS rank
FROM scores LEFT JOIN drawn ON scores.r = drawn.r
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, list_slice(w, p, p + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, range(1, 4) n(k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f, concat(lang, chr(1), phrase) AS key
                    FROM grams GROUP BY lang, phrase),
long AS MATERIALIZED (SELECT * FROM f WHERE len(g) >= 2 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, 1 AS cut, concat(lang, chr(1), g[1]) AS head, concat(lang, chr(1), array_to_string(g[2:], ' ')) AS tail FROM long
  UNION ALL SELECT lang, phrase, f, 2, concat(lang, chr(1), array_to_string(g[1:2], ' ')), concat(lang, chr(1), g[3]) FROM long WHERE len(g) = 3
), cuts AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, cut, CAST((1000000::HUGEINT * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM parts c JOIN f l ON l.key = c.head JOIN f r ON r.key = c.tail
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
cover AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, array_to_string(g[1:2], ' ') AS part, f FROM long WHERE len(g) = 3
    UNION ALL SELECT lang, array_to_string(g[2:3], ' '), f FROM long WHERE len(g) = 3) GROUP BY lang, part
), kept AS (
  SELECT best.lang, best.phrase, a, l, r, score FROM best LEFT JOIN cover ON best.lang = cover.lang AND best.phrase = cover.part
  WHERE cover.f IS NULL OR 100 * cover.f < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang) t ON ranked.lang = t.lang WHERE rank <= 2000
"""

ORACLE = {"op3_topk": TOPK, "op5_multi_index": NEAR_VECTORS, "op6_warc": WARC, "op9_sharding": SHARDING,
          "op11_decontamination": DECONTAMINATION, "op12_importance": IMPORTANCE, "op13_collocations": COLLOCATIONS}
