"""Query of the audit of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import audit


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same rows from DuckDB, by every pair and term.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), said AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), own AS (
  SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang
), g AS (
  SELECT a.lang, a.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN own USING (lang, source) GROUP BY a.lang, a.source
), shares AS (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(own.n, 0)::HUGEINT + 5)) // (g.total + 5 * v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (kept.total::HUGEINT + 5)) // (langs.total + 5 * v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
