"""SQL of the queries on files and record lines."""

from __future__ import annotations

#: Listings with their canonical paths. Escapes that are no UTF-8 don't occur in the tables.
FILES = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, n_bytes, regexp_replace(regexp_replace(path, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g'), '(?i)^file:(?:[/\\]{2}[^/\\]*)?([/\\])', '\1') AS p FROM doc_list WHERE path IS NOT NULL
), spelled AS (
  SELECT doc_id, n_bytes, replace(regexp_replace(nfc_normalize(url_decode(p)), '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g'), chr(92), '/') AS p FROM listed
), parts AS (
  SELECT doc_id, n_bytes, [x FOR x IN string_split(CASE WHEN starts_with(p, '/') THEN p ELSE 'ROOT/' || p END, '/') IF x NOT IN ('', '.')] AS s FROM spelled
), walk AS (
  SELECT doc_id, n_bytes, s, 0 AS i, CAST([] AS VARCHAR[]) AS way FROM parts
  UNION ALL SELECT doc_id, n_bytes, s, i + 1, CASE WHEN s[i + 1] = '..' THEN way[1:-2] ELSE list_append(way, s[i + 1]) END FROM walk WHERE i < len(s)
), file AS (
  SELECT way, min(doc_id) AS doc_id, max(n_bytes) AS n FROM walk WHERE i = len(s) GROUP BY way
), small AS (
  SELECT doc_id, n, '/' || array_to_string(way[1:-2], '/') AS folder FROM file
  WHERE starts_with('/' || array_to_string(way, '/'), 'ROOT/') AND n > 0 AND n < 8192
    AND regexp_matches(way[-1], '(?i)\.(mml|mathml|xhtml|html|tex)$') AND NOT regexp_matches(way[-1], '^[._]')
), crowded AS (SELECT *, count(*) OVER (PARTITION BY folder) AS m FROM small)
"""

_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"

#: Judged lines with their fields and the verdict on each rule.
LINES = r"""
WITH text AS (
  SELECT line_id, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS t FROM result_lines WHERE line IS NOT NULL
), judged AS (
  SELECT *, CASE WHEN regexp_matches(t, '^(E|"E")(\t|\z)') THEN 'E' WHEN regexp_matches(t, '^(R|"R")(\t|\z)') THEN 'R' END AS tag,
    regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quotes,
    [CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN regexp_extract_all(chr(9) || t, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1)] AS f
  FROM text
), shown AS (
  SELECT *, len(f) = CASE tag WHEN 'E' THEN 3 ELSE 5 END AS columns, f[CASE tag WHEN 'E' THEN 2 ELSE 4 END] AS expr FROM judged WHERE tag IS NOT NULL
), sign AS (
  SELECT line_id, unnest(s) AS s, generate_subscripts(s, 1) AS i, len(s) AS n FROM (SELECT line_id, regexp_extract_all(expr, '[\[\]]') AS s FROM shown WHERE quotes AND columns)
), depth AS (
  SELECT line_id, i, n, sum(CASE s WHEN '[' THEN 1 ELSE -1 END) OVER (PARTITION BY line_id ORDER BY i) AS d FROM sign
), balanced AS (
  SELECT line_id FROM depth GROUP BY line_id HAVING bool_and(CASE WHEN i < n THEN d > 0 ELSE d = 0 END)
), verdict AS (
  SELECT s.*, coalesce(starts_with(expr, '[') AND ends_with(expr, ']') AND b.line_id IS NOT NULL AND CASE tag
    WHEN 'E' THEN regexp_full_match(f[3], ' *\[ *[0-9]{1,18} *(?:, *[0-9]{1,18} *)*\] *')
    ELSE regexp_full_match(f[2], ' *[0-9]{1,18} *') AND regexp_full_match(f[3], ' *[0-9]{1,18} *')
      AND regexp_full_match(f[5], ' *NUM *| *\[ *NUM *, *NUM *, *NUM *\] *') AND list_max([CAST(x AS DOUBLE) FOR x IN regexp_extract_all(f[5], 'NUM')]) <= 1
    END, FALSE) AS good
  FROM shown s LEFT JOIN balanced b USING (line_id)
), loaded AS (
  SELECT line_id, tag, CASE tag WHEN 'R' THEN CAST(trim(f[2]) AS BIGINT) END AS doc, CASE tag WHEN 'R' THEN CAST(trim(f[3]) AS BIGINT) END AS pos, expr AS expression,
    CASE tag WHEN 'E' THEN [CAST(x AS BIGINT) FOR x IN regexp_extract_all(f[3], '[0-9]+')] END AS positions,
    CASE tag WHEN 'R' THEN [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(f[5], 'NUM')] END AS scores
  FROM verdict WHERE quotes AND columns AND good
)
""".replace("NUM", _NUMBER)
