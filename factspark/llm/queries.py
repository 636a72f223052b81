"""The corpus queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from .decontaminate import op9_decontamination
from .licenses import op10_license_scan
from .line_dedup import op3_line_dedup
from .mixing import op6_mixing
from .simhash import op2_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op4_suffix_array_dedup
from .toxicity import op8_toxicity
from .topk import op5_exact_topk
from .warc import op7_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_exact_topk": op5_exact_topk,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
}

OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS d FROM windows GROUP BY h
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 50))))) AS g
  FROM windows JOIN firsts USING (h) WHERE d < doc_id GROUP BY doc_id
), flags AS (
  SELECT doc_id, w, coalesce(g, []) AS g FROM words LEFT JOIN gone USING (doc_id)
), kept AS (
  SELECT f.doc_id, string_agg(f.w[f.p], ' ' ORDER BY f.p) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM flags) f
  LEFT JOIN (SELECT doc_id, unnest(g) AS p, true AS out FROM flags) x ON f.doc_id = x.doc_id AND f.p = x.p
  WHERE x.out IS NULL GROUP BY f.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM flags LEFT JOIN kept USING (doc_id)
"""

OP4_SQL = r"""
WITH hexes AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS i FROM hexes WHERE n >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS d FROM windows GROUP BY h
), hits AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM windows JOIN firsts USING (h) WHERE d < doc_id
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits
), spans AS (
  SELECT doc_id, r, min(i) AS a, max(i) + 49 AS b FROM runs GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM spans
  UNION ALL SELECT doc_id, max(b) + 1, NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT h.doc_id, string_agg(substr(x, (2 * a - 1)::BIGINT, (2 * (coalesce(b, n) - a + 1))::BIGINT), '' ORDER BY a) AS k
  FROM gaps g JOIN hexes h ON g.doc_id = h.doc_id WHERE coalesce(b, n) >= a GROUP BY h.doc_id
), sums AS (
  SELECT doc_id, sum(b - a + 1) AS gone, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE coalesce(k, '') END)) AS kept_sha256
FROM hexes h LEFT JOIN sums s ON h.doc_id = s.doc_id LEFT JOIN kept k ON h.doc_id = k.doc_id
"""

OP5_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
), groups AS (
  SELECT h, list_transform(range(0, 8), lambda k: ('0x' || substr(h, 1 + 5 * k, 5))::BIGINT) AS g FROM (SELECT DISTINCT h FROM p)
), digests AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[k // 4 + 1] >> (5 * (3 - k % 4))) & 31), 1)), '') AS payload_digest FROM groups
), firsts AS (
  SELECT h, min(page_id) AS f FROM p GROUP BY h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM p JOIN digests USING (h) JOIN firsts USING (h)
"""

OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM per
), filled AS (
  SELECT *, cap / weight AS fills, sum(source_size) OVER () * 1.5::DOUBLE AS everything, sum(weight) OVER () AS weights FROM ranked
), levels AS (
  SELECT *, (everything - coalesce(sum(cap) OVER b, 0.0)) / (weights - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM filled WINDOW b AS (ORDER BY fills, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (
  SELECT fills AS f, place AS p, level AS l FROM levels WHERE level < fills ORDER BY fills, place LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN l IS NOT NULL AND (fills > f OR (fills = f AND place >= p)) THEN l * weight ELSE cap END AS target
  FROM levels LEFT JOIN first ON true
), good AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM labels GROUP BY doc_id
), drawn AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    -ln((('0x' || substr(md5(concat_ws('|', '42', s.doc_id::VARCHAR, size::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / coalesce(w, 1.0::DOUBLE) AS key
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN good g ON s.doc_id = g.doc_id
), summed AS (
  SELECT *, floor(target)::BIGINT - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM summed
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), spans AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM spans)
), doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, n, s FROM doc_windows JOIN item_windows USING (n, x)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op4_suffix_array_dedup": OP4_SQL,
    "op5_exact_topk": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op9_decontamination": OP9_SQL,
}
