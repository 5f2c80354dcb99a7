"""DuckDB text for the quality rules."""

ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text AS given, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (
  SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS g,
    lead(word, 7) OVER o IS NOT NULL AS full8
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE full8) WHERE n > 1),
rep AS (SELECT r, sum(coalesce(least(8, i - p), 8)) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM again) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, text, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw FROM d)
),
worded AS (SELECT * FROM lines WHERE line <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM worded GROUP BY r),
hosts AS (SELECT source, count(DISTINCT (doc_id, given)) AS n FROM d GROUP BY source),
boiler AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT (doc_id, text)) AS n FROM worded GROUP BY ALL) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n >= 10 AND (l.n > 0.05 * h.n OR l.n >= 200)
),
lost AS (
  SELECT r, sum(len(string_split(line, ' '))) AS n FROM worded l
  WHERE EXISTS (SELECT 1 FROM boiler b WHERE b.source IS NOT DISTINCT FROM l.source AND b.line = l.line) GROUP BY r
),
tot AS (SELECT r, count(*) AS n, sum(length(word)) AS c FROM w GROUP BY r),
f AS (
  SELECT d.doc_id, CAST(coalesce(tot.n, 0) AS BIGINT) AS n_words, CAST(coalesce(tot.c, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boiler_words
  FROM d LEFT JOIN tot USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_boiler_words < 5 OR n_words - n_boiler_words < 0.3 * n_words) AS kept
FROM f
"""
