"""Query of quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import rules


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


#: The same rows from DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT doc_id, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), f AS (
  SELECT doc_id, text, host, words, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
), g AS (
  SELECT doc_id, text, i, array_to_string(words[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, text, words, unnest(generate_series(1, n_words - 4)) AS i FROM f WHERE n_words >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, text, host, line, len(string_split(line, ' ')) AS w FROM (
    SELECT doc_id, text, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
    FROM (SELECT doc_id, text, host, unnest(string_split(text, chr(10))) AS x FROM d)) WHERE line <> ''
), sharing AS (
  SELECT host, line FROM l JOIN (SELECT host, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY host) USING (host)
  GROUP BY host, line HAVING count(DISTINCT doc_id) > greatest(20, 0.01 * any_value(n_docs))
), gone AS (
  SELECT doc_id, CAST(sum(w) AS BIGINT) AS n FROM l JOIN sharing USING (host, line) GROUP BY doc_id
), r AS (
  SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed
  FROM f LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r
)
SELECT *, NOT base_failed AND n_removed <= 0.5 * n_words AS kept FROM b
"""
