"""Query of language identification: all pages and all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import host_of, identify, read_page, suffix_of


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document has its source for a host and declares nothing; page_id is null for it, doc_id for a page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    a = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"))
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), read_page(F.col("html")).alias("r"))
    b = read.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "r.text", "r.declared", "host", suffix_of(F.col("host")).alias("suffix"))
    return identify(a.unionByName(b), docs.select("text", "lang"))
