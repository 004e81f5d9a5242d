"""Query of WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .warc import page_id, page_records, read_warc, write_warc


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response's figures are those of the payload that was read; a revisit has none and gives those of its headers."""
    path = scratch(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary")
    rows = back.where(F.col("record_type").isin("response", "revisit"))
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return rows.select(page_id(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page_id(F.col("refers_to")).alias("refers_to"))


#: The same rows from DuckDB, without archives.
SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN first END AS refers_to
FROM r
"""
