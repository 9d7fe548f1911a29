"""SQL for DuckDB of the queries that it can express."""

from __future__ import annotations

from sensorlab.llm import lines

# Fixed value: a word, as the pattern that both engines read.
_WORD = r"'[^\x20\x09-\x0D]+'"
_GAP = r"'[\x20\x09-\x0D]'"


def _count(pattern: str, text: str = "line") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _line_rules() -> str:
    """Whether a line with words ``ws`` breaks a rule."""
    n = "len(ws)"
    letters = _count("[A-Za-zÀ-ÖØ-öø-ÿ]")
    phrases = " OR ".join(f"contains(lower(line), '{phrase}')" for phrase in lines.PHRASES)
    end = lines._END.pattern.replace("'", "''")
    rules = [
        f"5 * {_count('[|>»·•]')} >= {n}",
        f"100 * {_count('[#*$%&<>]')} > 30 * {n}",
        f"({letters} >= 10 AND 2 * {_count('[A-ZÀ-ÖØ-Þ]')} > {letters})",
        f"100 * len([i for i in range(1, {n}) if ws[i] = ws[i + 1]]) > 30 * {n}",
        "again > 1",
        f"({n} < 60 AND ({phrases}))",
        f"NOT regexp_matches(line, '{end}')",
    ]
    return " OR ".join(rules)


OP3 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT row_no, doc_id, text, regexp_extract_all(text, {_WORD}) AS ws FROM texts
), windows AS (
  SELECT row_no, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT row_no, ws, unnest(range(1, len(ws) - 6)) AS i FROM counted)
), twice AS (
  SELECT row_no, unnest(places) AS i FROM (
    SELECT row_no, list(i) AS places FROM windows GROUP BY row_no, w HAVING count(*) > 1)
), covered AS (
  SELECT row_no, count(DISTINCT p) AS n FROM (
    SELECT row_no, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY row_no
), split AS (
  SELECT row_no, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT row_no, string_split(text, chr(10)) AS parts FROM texts)
), filled AS (
  SELECT *, regexp_extract_all(line, {_WORD}) AS ws FROM split WHERE regexp_matches(line, {_WORD})
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY row_no, line ORDER BY place) AS again FROM filled
), judged AS (
  SELECT row_no, again, length(regexp_replace(line, {_GAP}, '', 'g')) AS chars,
    ({_line_rules()}) AS fails FROM numbered
), by_text AS (
  SELECT row_no, count(*) FILTER (WHERE again > 1) AS n_dup_lines,
    count(*) FILTER (WHERE fails) AS n_failed_lines,
    CAST(coalesce(sum(chars) FILTER (WHERE fails), 0) AS BIGINT) AS lost_chars
  FROM judged GROUP BY row_no
), sums AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, {_GAP}, '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM counted LEFT JOIN covered USING (row_no) LEFT JOIN by_text USING (row_no)
), base AS (
  SELECT *, n_words < {lines.LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM sums
)
SELECT *, NOT base_failed AND 100 * lost_chars <= {lines.MAX_LOSS} * word_chars AS kept FROM base
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) >= 5
      THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
      ELSE [array_to_string(ws, ' ')] END) AS shingle
  FROM texts WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reached AS (
  SELECT doc_id, doc_id AS other FROM texts
  UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other
), roots AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

SQL = {"op3_line_rules": OP3, "op7_minhash_dedup": OP7}
