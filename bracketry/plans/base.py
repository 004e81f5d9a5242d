"""The contest relation that the queries read: orders between two customers, with a rule for each column, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.twosided import sides

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as hold so many rows each, of rows in all; they stay apart, so that tasks stay small on any size."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0) + 1
    o = table(spark, sf_dir, "orders")
    b = (F.col("o_orderkey") * 7 + 3) % n
    p = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("contest_id"),
        F.col("o_custkey").alias("a_id"),
        b.alias("b_id"),
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).when(F.col("o_orderstatus") == "O", b).alias("winner_id"),
        F.when(p == "1", "ko").when(p == "2", "submission").when(p.isin("3", "4"), "decision").alias("method"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("round"),
        (F.col("o_orderkey") * 37 % 300).cast("int").alias("seconds"),
        F.when(F.col("o_orderkey") % 9 == 0, 5).otherwise(3).alias("scheduled"),
        F.element_at(F.array(*map(F.lit, ("light", "middle", "heavy", "open"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("division"),
        F.col("o_totalprice").alias("purse"),
    ).where("a_id <> b_id")


def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(contests(spark, sf_dir))


#: contest and side as above; goes in front of a query's own tables.
CONTEST = f"""
WITH contest AS (
  SELECT * FROM (
    SELECT o_orderkey AS contest_id, o_custkey AS a_id, (o_orderkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS b_id, CAST(o_orderdate AS DATE) AS day,
           CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN (o_orderkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) END AS winner_id,
           CASE WHEN o_orderpriority LIKE '1%' THEN 'ko' WHEN o_orderpriority LIKE '2%' THEN 'submission' WHEN left(o_orderpriority, 1) IN ('3', '4') THEN 'decision' END AS method,
           CAST(o_orderkey % 5 + 1 AS INTEGER) AS round, CAST(o_orderkey * 37 % 300 AS INTEGER) AS seconds, CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 3 END AS scheduled,
           (['light', 'middle', 'heavy', 'open'])[o_orderkey % 4 + 1] AS division, o_totalprice AS purse
    FROM orders) WHERE a_id <> b_id
), side AS (
  SELECT *, CASE WHEN winner_id IS NULL THEN 'D' WHEN winner_id = entity THEN 'W' ELSE 'L' END AS result FROM (
    SELECT contest_id, day, winner_id, method, round, seconds, scheduled, division, purse, 'a' AS side, a_id AS entity, b_id AS opponent FROM contest
    UNION ALL
    SELECT contest_id, day, winner_id, method, round, seconds, scheduled, division, purse, 'b', b_id, a_id FROM contest)
), as_of AS (SELECT DATE '{AS_OF}' AS as_of)"""
