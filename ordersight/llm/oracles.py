"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

#: Word class and line rules as in quality_rules; repeated windows through a self-contained window count.
OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents
), u AS (SELECT DISTINCT t FROM d
), w AS (
  SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM u
), m AS (
  SELECT t, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines
  FROM w
), g AS (
  SELECT t, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), rep AS (
  SELECT t, i FROM (SELECT t, i, count(*) OVER (PARTITION BY t, a, b, c) AS k FROM g) WHERE k >= 2
), covered AS (
  SELECT t, count(DISTINCT p) AS n_repeat_words FROM (SELECT t, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY t
), ln AS (
  SELECT t, n.norm, len(string_split(n.norm, ' ')) AS nw
  FROM (SELECT t, unnest(list_transform(l, lambda x: trim(regexp_replace(
          trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')))) AS norm FROM w) n
  WHERE n.norm <> ''
), freq AS (
  SELECT host, norm, min(md5(t)) AS first_sig
  FROM (SELECT DISTINCT d.host, ln.norm, ln.t FROM ln JOIN (SELECT DISTINCT host, t FROM d) d USING (t))
  GROUP BY host, norm HAVING count(*) > 30
), gone AS (
  SELECT freq.host, ln.t, count(*) AS removed_lines, sum(nw) AS removed_words
  FROM ln JOIN freq USING (norm) WHERE md5(ln.t) <> freq.first_sig GROUP BY freq.host, ln.t
), j AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d JOIN m USING (t) LEFT JOIN covered USING (t) LEFT JOIN gone ON gone.t = d.t AND gone.host = d.host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_lines, removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (removed_words > 0 AND (n_words - removed_words < 50 OR 100 * removed_words > 60 * n_words)) AS kept
FROM j
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""

#: Every anchor scored against every row; ranks by score, then id.
OP13 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
) WHERE rank <= 10
"""

ORACLE: dict[str, str] = {"op1_quality_rules": OP1, "op10_exact_dedup": OP10, "op13_hard_negatives": OP13}
