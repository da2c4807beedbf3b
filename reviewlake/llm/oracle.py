"""DuckDB SQL for those numbered operators that SQL can express."""

from __future__ import annotations

from reviewlake.llm import licences

#: Near words share what is left after one code point is taken out; crc32 runs over hexadecimal bytes by a table of its rule.
SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c
    FROM (SELECT unnest(range(256)) AS b))
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
hashed AS (
  SELECT run, count, xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
           lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT id, run, count(*) AS count FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc_table
),
words AS (
  SELECT word, CAST(sum(count) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, count FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(count) >= 5
),
cut AS (
  SELECT word, n, place, left(word, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word != b.word
  UNION
  SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION
  SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
),
near AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM pairs GROUP BY word
),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
         CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
),
steps AS (
  SELECT word, word AS root, form AS next FROM found
  UNION ALL
  SELECT s.word, s.next, f.form FROM steps s JOIN found f ON f.word = s.next
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM found f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """Query name to SQL over the given tables."""
    return {"op9_licence_digests": licences.scan_sql(), "op12_spelling_variants": SPELLING}
