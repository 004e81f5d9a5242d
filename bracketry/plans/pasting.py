"""Customers as text that someone pasted, and their records out of it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import scratch
from ..sources.paste import Kind, fields, records
from .base import table
from .registry import query

KINDS = [Kind("name", r"^(Customer#\d+)$"), Kind("nation", r"^(\d+)$"), Kind("segment", r"^Segment: (.+)$"), Kind("cents", r"^Balance: (-?\d+)$"), Kind("marks", r"^\*(\w+)$", True)]


@query("""
SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
       CAST(c_custkey % 3 AS INTEGER) AS marks
FROM customer""")
def q_pasted_records(spark, sf):
    """Each customer as up to six lines with headers and blanks between them, stored as text and read back as records."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    marks = F.when(key % 3 == 1, F.lit("*a")).when(key % 3 == 2, F.lit("*a\t*b"))
    header = F.when(key % 40 == 0, F.lit("Name\tNation"))
    lines = [header, F.concat("c_name", F.lit("\t"), "c_nationkey"), F.lit(""), F.concat(F.lit("Segment: "), "c_mktsegment"), marks, F.concat(F.lit("Balance: "), F.round(F.col("c_acctbal") * 100).cast("long"))]
    path = scratch(spark, "pasted")
    c.select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    found = records(spark, path, r"^Customer#\d+\t", r"^Name\t").select(fields(F.col("lines"), KINDS).alias("f")).select("f.*")
    return found.select("name", "nation", "segment", F.col("cents").cast("long").alias("cents"), F.size("marks").alias("marks"))
