"""DuckDB SQL for those of the registered queries that SQL can express.

The others (edit distance, token files, page text, piece lattices, pseudonyms,
fitted models, sketches) are compared with brute-force versions in the tests.
"""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

# Windows of items, of ten words or the whole item, found at every place of every document.
DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(s) WHERE len(w) > 0
), places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM item_windows), unnest(range(1, len(w) - n + 2)) AS r(s)
), hits AS (
  SELECT doc_id, n, s, item_id FROM places JOIN item_windows USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# All pairs of documents that share a word pair, then all that reach each other.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), members AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS m FROM d
), sizes AS (
  SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM members a JOIN members b ON a.m = b.m AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * k >= 80 * (a.n + b.n - k)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least_ids AS (
  SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ids USING (doc_id)
"""

PREFERENCE_PAIRS = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS odd, turn, coalesce(role, '') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
         row_number() OVER (PARTITION BY pair_id, odd ORDER BY turn NULLS FIRST, role, text) AS place FROM t
), c AS (SELECT * FROM r WHERE odd = 0), j AS (SELECT * FROM r WHERE odd = 1),
pairs AS (SELECT pair_id, count(*) FILTER (odd = 0) AS nc, count(*) FILTER (odd = 1) AS nj FROM r GROUP BY 1),
differ AS (
  SELECT coalesce(c.pair_id, j.pair_id) AS pair_id, min(coalesce(c.place, j.place)) AS place
  FROM c FULL JOIN j ON c.pair_id = j.pair_id AND c.place = j.place
  WHERE (c.role = j.role AND c.text = j.text) IS NOT TRUE GROUP BY 1
), cuts AS (
  SELECT pair_id, nc, nj, coalesce(place - 1, nc) AS n FROM pairs LEFT JOIN differ USING (pair_id)
), placed AS (
  SELECT r.*, n, place > n AS rest,
         sum(length(rendered)) FILTER (place > n) OVER (PARTITION BY pair_id, odd ORDER BY place) AS upto
  FROM r JOIN cuts USING (pair_id)
), whole AS (
  SELECT pair_id, odd, string_agg(rendered, '' ORDER BY place) FILTER (NOT rest) AS prompt,
         coalesce(string_agg(rendered, '' ORDER BY place) FILTER (rest), '') AS completion,
         coalesce(string_agg((upto - 11 - length(text))::BIGINT || '-' || (upto - 1)::BIGINT, ',' ORDER BY place)
                  FILTER (rest AND role = 'assistant'), '') AS mask
  FROM placed GROUP BY 1, 2
)
SELECT pair_id, n::BIGINT AS n_prompt_turns, coalesce(a.prompt, '') AS prompt, a.completion AS chosen,
       a.mask AS chosen_mask, b.completion AS rejected, b.mask AS rejected_mask
FROM cuts LEFT JOIN (SELECT * FROM whole WHERE odd = 0) a USING (pair_id)
          LEFT JOIN (SELECT * FROM whole WHERE odd = 1) b USING (pair_id)
"""

# Five hexadecimal digits of a digest are four base32 digits.
WARC_BUNDLES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(sha1(h), (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - i % 4 * 5)) & 31), 1)), '') AS payload_digest,
       CASE WHEN last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

ORACLES: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op4_preference_pairs": PREFERENCE_PAIRS,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op11_warc_bundles": WARC_BUNDLES,
    "op12_hard_negatives": HARD_NEGATIVES,
}
