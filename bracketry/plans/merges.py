"""Merging batches into tables: overwrite, fill, monotone rules, survivors, logs and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import merge as M
from .base import table
from .registry import query

#: The table is the customers; the batch has spend, last order and segment of customers, some of whom are new, some without a segment.
BATCH = """
WITH old AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS balance, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'completed' ELSE 'scheduled' END AS status, DATE '1998-01-01' AS first_seen FROM customer),
new AS (SELECT o_custkey + 100 AS id, round(sum(o_totalprice), 2) AS balance, CASE WHEN count(*) % 2 = 0 THEN min(o_orderpriority) END AS segment, 'scheduled' AS status, CAST(min(o_orderdate) AS DATE) AS first_seen FROM orders GROUP BY 1)
"""


def old(spark, sf):
    status = F.when(F.col("c_custkey") % 3 == 0, "completed").otherwise("scheduled")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("balance"), F.col("c_mktsegment").alias("segment"), status.alias("status"), F.lit("1998-01-01").cast("date").alias("first_seen"))


def new(spark, sf):
    g = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 100).alias("id"))
    return g.agg(F.round(F.sum("o_totalprice"), 2).alias("balance"), F.when(F.count("*") % 2 == 0, F.min("o_orderpriority")).alias("segment"), F.lit("scheduled").alias("status"), F.to_date(F.min("o_orderdate")).alias("first_seen"))


@query(BATCH + """
SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL THEN old.balance ELSE new.balance END AS balance, CASE WHEN new.id IS NULL THEN old.segment ELSE new.segment END AS segment
FROM old FULL JOIN new ON old.id = new.id""")
def q_full_merge_overwrite(spark, sf):
    return M.upsert(old(spark, sf), new(spark, sf), ["id"], {}).select("id", "balance", "segment")


@query(BATCH + "SELECT coalesce(old.id, new.id) AS id, coalesce(new.segment, old.segment) AS segment, coalesce(old.balance, new.balance) AS balance FROM old FULL JOIN new ON old.id = new.id")
def q_merge_fill_only(spark, sf):
    return M.upsert(old(spark, sf), new(spark, sf), ["id"], {"segment": M.fill_new, "balance": M.fill_old}).select("id", "segment", "balance")


@query(BATCH + """
SELECT coalesce(old.id, new.id) AS id, greatest(old.balance, new.balance) AS balance, least(old.first_seen, new.first_seen) AS first_seen,
       CASE WHEN old.status = 'completed' THEN 'completed' ELSE coalesce(new.status, old.status) END AS status FROM old FULL JOIN new ON old.id = new.id""")
def q_merge_monotone(spark, sf):
    rules = {"balance": M.larger, "first_seen": M.smaller, "status": M.no_demotion("completed")}
    return M.upsert(old(spark, sf), new(spark, sf), ["id"], rules).select("id", "balance", "first_seen", "status")


@query(BATCH + "SELECT id, balance FROM old UNION ALL SELECT id, balance FROM new WHERE id NOT IN (SELECT id FROM old)")
def q_insert_ignore(spark, sf):
    return M.insert_new(old(spark, sf).select("id", "balance"), new(spark, sf).select("id", "balance"), ["id"])


@query("SELECT c_custkey AS id, coalesce(n, 0) AS urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def q_update_reset(spark, sf):
    values = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("urgent"))
    return M.update_from(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(9).cast("long").alias("urgent")), values, "id", {"urgent": 0})


OFFICIAL = "SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'"


@query(f"WITH f AS ({OFFICIAL}) SELECT o_orderkey FROM orders LEFT JOIN f ON f.o_custkey = orders.o_custkey AND f.day = CAST(o_orderdate AS DATE) WHERE NOT (o_orderstatus = 'O' AND f.day IS NOT NULL)")
def q_delete_superseded(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return M.delete_superseded(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "day"], F.col("o_orderstatus") == "O").select("o_orderkey")


KEPT = """
WITH r AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, min(CAST(o_orderdate AS DATE)) OVER w AS first_seen, first_value(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) AS keeper
FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate)))"""


def _survivors(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("first_seen"))
    return o, M.survivors(o, ["o_custkey", "year"], [(F.col("o_orderstatus") == "F").desc(), F.col("o_orderkey")], "first_seen")


@query(KEPT + "SELECT o_orderkey, o_custkey, first_seen FROM r WHERE o_orderkey = keeper")
def q_survivor_dedup(spark, sf):
    return _survivors(spark, sf)[1].select("o_orderkey", "o_custkey", "first_seen")


@query(KEPT + "SELECT keeper AS o_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN r ON r.o_orderkey = l_orderkey GROUP BY 1")
def q_repointed(spark, sf):
    """Lines counted under the orders that survive."""
    every, kept = _survivors(spark, sf)
    ids = every.join(kept.select("o_custkey", "year", F.col("o_orderkey").alias("keeper")), ["o_custkey", "year"]).select("o_orderkey", "keeper")
    lines = table(spark, sf, "lineitem")
    known = lines.join(ids.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    moved = M.replaced_ids(known, "l_orderkey", ids, "o_orderkey", "keeper")
    return moved.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01') THEN 'kept' ELSE 'gone' END AS fate FROM customer")
def q_retire_missing(spark, sf):
    listed = table(spark, sf, "orders").where("o_orderdate >= timestamp '2001-06-01'").select(F.col("o_custkey").alias("id")).distinct()
    kept, gone = M.retire_missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), listed, ["id"])
    return kept.select("id", F.lit("kept").alias("fate")).unionAll(gone.select("id", F.lit("gone").alias("fate")))


@query(BATCH + """
SELECT id, 'segment' AS "column", o.segment AS before, n.segment AS after FROM old o JOIN new n USING (id) WHERE o.segment IS DISTINCT FROM n.segment
UNION ALL SELECT id, 'status', o.status, n.status FROM old o JOIN new n USING (id) WHERE o.status IS DISTINCT FROM n.status""")
def q_changed_columns(spark, sf):
    return M.changed_columns(old(spark, sf), new(spark, sf), "id", ["segment", "status"])


@query("""
SELECT event_id, user_id, round(sum(CASE WHEN event_type = 'purchase' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS balance_after FROM events""")
def q_ledger_balance(spark, sf):
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", "user_id", F.round(F.sum(amount).over(H.upto("user_id", "ts", "event_id")), 4).alias("balance_after"))


@query("""
SELECT s_suppkey, n_lines IS NOT NULL AS has_lines, n_returned > 0 AS has_returns FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def q_gap_flags(spark, sf):
    """Which dependents each parent has."""
    own = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    s = table(spark, sf, "supplier")
    return s.join(own, s.s_suppkey == own.l_suppkey, "left").select("s_suppkey", F.col("n").isNotNull().alias("has_lines"), (F.col("r") > 0).alias("has_returns"))


@query("""
SELECT l_suppkey, l_shipdate, l_partkey, places FROM (
  SELECT l_suppkey, l_shipdate, l_partkey, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS places, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_partkey, l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def q_first_with_count(spark, sf):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")]
    counted = table(spark, sf, "lineitem").withColumn("places", F.count("*").over(Window.partitionBy("l_suppkey", "l_partkey")))
    return H.first_by(counted, ["l_suppkey"], order).select("l_suppkey", "l_shipdate", "l_partkey", "places")
