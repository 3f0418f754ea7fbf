"""DuckDB SQL that returns the same rows as the registered queries, written from the contracts."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINE_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
normal AS (SELECT doc_id, source, n, trim(regexp_replace(regexp_replace({_LOW.format('line')}, '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') AS k FROM worded),
frequent AS (SELECT source, k FROM normal GROUP BY source, k HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT doc_id, sum(n) AS n_lost FROM normal n WHERE EXISTS (SELECT 1 FROM frequent f WHERE f.source IS NOT DISTINCT FROM n.source AND f.k = n.k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost, 0) AS n_lost
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_lost > 0 AND n_words - n_lost < 0.5 * n_words) AS kept, CAST(n_lost AS BIGINT) AS n_removed_words
FROM j
"""

_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i, s[i] AS line, trim({_LOW.format('s[i]')}, {_BLANKS}) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
often AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, coalesce(o.last_doc <> l.doc_id, false) AS gone FROM lines l LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_FIVE_BITS = ", ".join(f"'{i:05b}'" for i in range(32))
_FOUR_BITS = ", ".join(f"'{i:04b}'" for i in range(16))

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda j: [{_FOUR_BITS}][strpos('0123456789abcdef', hex[j])]), '') AS bits FROM h)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_position([{_FIVE_BITS}], substr(bits, 5 * i + 1, 5))]), '') AS payload_digest,
       CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first > page_id THEN first END AS refers_to
FROM b
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORDS}) AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
ds AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS span
  FROM d, (SELECT DISTINCT size FROM bs) AS s, unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT doc_id, i, ds.size AS size, item_id FROM ds JOIN bs ON ds.size = bs.size AND ds.span = bs.span),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_HARD_NEGATIVES = """
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda x: floor(256 * x)) AS e FROM whole),
pairs AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
good AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM good AS p JOIN pairs AS n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 10
"""

SQL = {"op3_decontamination": _DECONTAMINATION, "op4_warc": _WARC, "op5_line_rules": _LINE_RULES, "op7_line_dedup": _LINE_DEDUP,
       "op12_hard_negatives": _HARD_NEGATIVES}
