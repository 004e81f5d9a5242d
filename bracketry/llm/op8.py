"""Query of line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linededup import dedup_lines


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


#: The same rows from DuckDB: every run from a line on that has 50 words first with its last line, and every run to one.
SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents
), l AS (
  SELECT doc_id, line_no, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq, sum(w) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto
  FROM (SELECT *, len(string_split(line, ' ')) AS w FROM l WHERE line <> '')
), ends AS (
  SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.seq) AS s, b.seq AS e FROM f b JOIN f a ON a.doc_id = b.doc_id AND a.seq BETWEEN b.seq - 49 AND b.seq AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.seq
), runs AS (
  SELECT ends.doc_id, s, e, string_agg(line, chr(10) ORDER BY seq) AS run FROM ends JOIN f ON f.doc_id = ends.doc_id AND seq BETWEEN s AND e GROUP BY ALL
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT f.doc_id, line_no FROM later JOIN f ON f.doc_id = later.doc_id AND seq BETWEEN s AND e
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.line_no) AS n_removed,
       coalesce(string_agg(CAST(gone.line_no AS VARCHAR), ',' ORDER BY gone.line_no) FILTER (gone.line_no IS NOT NULL), '') AS removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY l.line_no) FILTER (gone.line_no IS NULL), '')) AS text_md5
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line_no = l.line_no GROUP BY l.doc_id
"""
