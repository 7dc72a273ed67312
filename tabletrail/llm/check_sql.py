"""The results of op5, op6, op9, op12 and op13 in DuckDB SQL, by comparing everything with everything."""

from __future__ import annotations

import string


def _shingles(table: str, key: str) -> str:
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM (SELECT {key}, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) AS words_of_{table}"""


NEAR_COPIES = f"""
WITH RECURSIVE sets AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) AS p
  JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) AS c LEFT JOIN sizes USING (doc_id)"""

CONTAINED = f"""
WITH sets AS MATERIALIZED ({_shingles('documents', 'doc_id')}),
items AS MATERIALIZED ({_shingles('benchmark', 'item_id')}),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment
FROM (SELECT doc_id, item_id, count(*) AS c FROM sets JOIN items USING (shingle) GROUP BY 1, 2) AS p JOIN sizes USING (item_id)
WHERE c >= 0.8 * n"""

REPEATS = """
WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
repeated AS MATERIALIZED (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY piece ORDER BY doc_id, i) AS place FROM (
      SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM bytes) AS w) AS p) AS r
  WHERE place > 1),
spans AS MATERIALIZED (
  SELECT doc_id, min(i) AS first, max(i) + 100 AS past FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM repeated) AS f) AS s
  GROUP BY doc_id, span),
gaps AS (SELECT doc_id, first, past, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS following FROM spans),
kept AS (
  SELECT doc_id, sum(past - first) AS n_removed, count(*) AS n_spans, substr(any_value(h), 1, 2 * min(first)) ||
    string_agg(substr(h, 2 * past + 1, 2 * (coalesce(following, length(h) // 2) - past)), '' ORDER BY first) AS rest
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)"""

#: crc32 byte by byte over the hexadecimal digits of the UTF-8 text; near words share what is left when one code point is left out.
VARIANTS = f"""
WITH RECURSIVE steps AS (
  SELECT list(CAST(list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n) AS numbers),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS h FROM runs GROUP BY doc_id, run),
checked AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)])), 4294967295) AS crc FROM counted, steps),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN crc % 97 = 0 THEN concat(substr(run, 1, CAST(crc % length(run) AS BIGINT)), substr(run, CAST(crc % length(run) + 2 AS BIGINT))) ELSE run END AS word FROM checked) AS d
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
lacking AS MATERIALIZED (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words) AS places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM lacking a JOIN lacking b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word FROM lacking l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM lacking l JOIN words w ON w.word = l.rest),
best AS (
  SELECT word, n_near, CASE WHEN n_other >= 2 * n THEN other END AS form, CASE WHEN n_other >= 2 * n THEN n_other END AS form_n FROM (
    SELECT v.word, v.n, o.other, w.n AS n_other, count(*) OVER (PARTITION BY v.word) AS n_near, row_number() OVER (PARTITION BY v.word ORDER BY w.n DESC, encode(o.other)) AS place
    FROM near o JOIN words v ON v.word = o.word JOIN words w ON w.word = o.other) AS ranked
  WHERE place = 1),
chains(word, root) AS (SELECT word, form FROM best WHERE form IS NOT NULL UNION ALL SELECT c.word, b.form FROM chains c JOIN best b ON b.word = c.root WHERE b.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains c LEFT JOIN best b ON b.word = c.root WHERE b.form IS NULL)
SELECT w.word, b.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN ends e ON e.word = w.word"""



def _terms(table: str, key: str) -> str:
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""SELECT {key}, unnest(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"""


SEARCH = f"""
WITH counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_terms('documents', 'doc_id')}) AS d GROUP BY doc_id, term),
lengths AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS MATERIALIZED (SELECT DISTINCT item_id, term FROM ({_terms('benchmark', 'item_id')}) AS i),
weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) AS ranked
WHERE place <= 10"""

ORACLES = {"op5_minhash_near_copies": NEAR_COPIES, "op6_benchmark_containment": CONTAINED, "op9_suffix_repeats": REPEATS, "op12_variant_groups": VARIANTS, "op13_lexical_search": SEARCH}
