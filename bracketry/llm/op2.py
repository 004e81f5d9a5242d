"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "n_words")


#: The same rows from DuckDB: every window with an item's shingle in it, compared with that item.
SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM (SELECT doc_id, w, len(w) - 4 AS n, unnest(generate_series(0, len(w) - 5)) AS p FROM dw WHERE len(w) >= 5)
), ish AS (
  SELECT item_id, n, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM (SELECT item_id, w, len(w) - 4 AS n, unnest(generate_series(0, len(w) - 5)) AS p FROM iw WHERE len(w) >= 5)
), ic AS (
  SELECT item_id, n, h, count(*) AS c FROM ish GROUP BY ALL
), starts AS (
  SELECT DISTINCT doc_id, item_id, ic.n, least(ic.n, ds.n) AS m, unnest(generate_series(greatest(0, p - least(ic.n, ds.n) + 1), least(p, ds.n - least(ic.n, ds.n)))) AS s
  FROM ds JOIN ic USING (h) JOIN (SELECT doc_id, item_id FROM ds JOIN ic USING (h) GROUP BY ALL HAVING count(*) >= 0.8 * any_value(least(ic.n, ds.n))) USING (doc_id, item_id)
), wc AS (
  SELECT doc_id, item_id, s, n, m, ds.h, count(*) AS c FROM starts JOIN (SELECT doc_id, p, h FROM ds) ds USING (doc_id) WHERE p BETWEEN s AND s + m - 1 GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, s, n, m, sum(least(wc.c, ic.c)) AS o FROM wc JOIN (SELECT item_id, h, c FROM ic) ic USING (item_id, h) GROUP BY ALL
), ok AS (
  SELECT doc_id, item_id, s, m + 4 AS n_words, o / (n + m - o) AS similarity FROM sim WHERE o / (n + m - o) >= 0.8
)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, s AS start_word, n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS k FROM ok) WHERE k = 1
"""
