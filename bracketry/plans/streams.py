"""Time-ordered queries: windows, sessions, change logs, cutoffs, and spreading along links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import history as H
from .base import CONTEST, contests, table
from .registry import query


@query("""
SELECT CAST(DATE '2024-01-01' + CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 14 * 14 AS INTEGER) AS DATE) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q_tumbling_14d(spark, sf):
    """Buckets of fourteen days anchored at a start day."""
    w = F.window("ts", "14 days", startTime="11 days")  # windows from 1970-01-12 on, and so from 2024-01-01
    e = table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.to_date("w.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)""")
def q_sliding_7d(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-7 * 86400, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 6).alias("mean"))


SESSIONS = """
WITH g AS (SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) <= 21600 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS session FROM g)
"""


@query(SESSIONS + "SELECT user_id, session, count(*) AS n, min(ts) AS first, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def q_sessionize(spark, sf):
    s = H.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.round(F.sum("value"), 4).alias("total"))


TICK = "SELECT event_id, ts, user_id, event_type, CAST(floor(value / 25) AS BIGINT) AS price FROM events"


def ticks(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") / 25).alias("price"))


@query(f"WITH t AS ({TICK}) SELECT event_id, user_id, event_type, price FROM (SELECT *, lag(price) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM t) WHERE p IS NULL OR p <> price")
def q_change_only_ticks(spark, sf):
    return H.changes_only(ticks(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], "price").select("event_id", "user_id", "event_type", "price")


@query(f"WITH t AS ({TICK}) SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM t) WHERE p IS DISTINCT FROM event_type")
def q_dedup_latest_signature(spark, sf):
    """An entry stays if it differs from the one that was recorded before it for the same key."""
    return H.changes_only(ticks(spark, sf), ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "event_type")


@query(f"WITH t AS ({TICK}) SELECT min(event_id) AS event_id, user_id, event_type, price FROM t GROUP BY user_id, event_type, price")
def q_dedup_any_signature(spark, sf):
    return ticks(spark, sf).groupBy("user_id", "event_type", "price").agg(F.min("event_id").alias("event_id"))


@query("""
WITH c AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') + CASE WHEN user_id % 3 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END AS cutoff FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e JOIN c USING (user_id) WHERE e.ts < c.cutoff""")
def q_cutoff_filter(spark, sf):
    """Observations before a cutoff that each key has of its own."""
    e = table(spark, sf, "events")
    grace = F.when(F.col("user_id") % 3 == 0, F.expr("interval 12 hours")).otherwise(F.expr("interval 6 hours"))
    c = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last")).select("user_id", (F.col("last") + grace).alias("cutoff"))
    return e.join(c, "user_id").where("ts < cutoff").select("event_id", "user_id")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY abs(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) - 43200), event_id) AS k FROM events) WHERE k = 1""")
def q_nearest_midpoint(spark, sf):
    """The observation nearest to each day's noon."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    away = F.abs(F.unix_timestamp("ts") - F.unix_timestamp(F.col("day").cast("timestamp")) - 43200)
    return H.first_by(e, ["user_id", "day"], [away, F.col("event_id")]).select("user_id", "day", "event_id")


@query(CONTEST + """
, r AS (SELECT contest_id, count(DISTINCT l_linenumber) AS rounds, any_value(round) AS needed, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS knockdowns FROM contest JOIN lineitem ON l_orderkey = contest_id GROUP BY contest_id)
SELECT contest_id, rounds >= needed AS complete, CASE WHEN rounds >= needed THEN knockdowns END AS knockdowns FROM r""")
def q_deferred_settlement(spark, sf):
    """A side bet settles only once every round is in."""
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.countDistinct("l_linenumber").alias("rounds"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("knockdowns"))
    r = contests(spark, sf).select("contest_id", "round").join(i, "contest_id")
    done = F.col("rounds") >= F.col("round")
    return r.select("contest_id", done.alias("complete"), F.when(done, F.col("knockdowns")).alias("knockdowns"))


LINKS = "WITH RECURSIVE link AS (SELECT DISTINCT user_id AS a, CAST(floor(value * 100) AS BIGINT) + 1000000 AS b FROM events WHERE event_type = 'purchase')"


@query(LINKS + """
, both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link), walk AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT w.node, e.b FROM walk w JOIN both_ e ON e.a = w.seen)
SELECT node, min(seen) AS root FROM walk GROUP BY node""")
def q_components(spark, sf):
    """Users and the prices that they paid in common, as connected components."""
    link = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("a"), (F.floor(F.col("value") * 100) + 1000000).alias("b")).distinct()
    return graph.smallest_reachable(link, "a", "b")


@query(CONTEST.replace("WITH", "WITH RECURSIVE", 1) + """
, both_ AS (SELECT DISTINCT a_id AS x, b_id AS node FROM contest UNION SELECT DISTINCT b_id, a_id FROM contest),
seed AS (SELECT DISTINCT c_custkey AS node, c_mktsegment AS label FROM customer WHERE c_acctbal > 9500),
walk AS (SELECT node, 0 AS d FROM seed UNION SELECT e.node, w.d + 1 FROM walk w JOIN both_ e ON e.x = w.node WHERE w.d < 60),
dist AS (SELECT node, min(d) AS d FROM walk GROUP BY node),
lab AS (
  SELECT node, label, 0 AS d FROM seed
  UNION ALL
  SELECT node, arg_min(label, (-n, label)), d + 1 FROM (
    SELECT e.node, l.label, l.d, count(*) AS n FROM lab l JOIN both_ e ON e.x = l.node JOIN dist t ON t.node = e.node AND t.d = l.d + 1 GROUP BY ALL) GROUP BY node, d
)
SELECT node, label FROM lab""")
def q_label_propagation(spark, sf):
    """Segments of a few customers spread along contests, as far as these reach."""
    c = table(spark, sf, "customer")
    seeds = c.where("c_acctbal > 9500").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))
    return graph.spread(seeds, contests(spark, sf).select("a_id", "b_id"), "a_id", "b_id")
