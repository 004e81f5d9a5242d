"""Histories of entities: records, form, streaks, running figures, decay and activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import history as H
from ..operators.scan import sums_before
from .base import AS_OF, CONTEST, contests, perspectives, table
from .registry import query

ORDER = ["day", "contest_id"]
RECENT = "row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS rn"
#: Weights of the last five contests.
FORM_WEIGHTS = [2.0, 1.5, 1.0, 0.75, 0.5]


def as_of():
    return F.lit(AS_OF).cast("date")


@query(CONTEST + " SELECT entity, contest_id, opponent, result FROM side")
def q_unpivot_results(spark, sf):
    return perspectives(spark, sf).select("entity", "contest_id", "opponent", "result")


@query(CONTEST + """
SELECT entity, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses, count(*) FILTER (result = 'D') AS draws,
       count(*) FILTER (result = 'W' AND method = 'ko') AS ko_wins, count(DISTINCT opponent) FILTER (result = 'W') AS beaten,
       round(count(*) FILTER (result = 'W') / count(*), 6) AS win_rate FROM side GROUP BY entity""")
def q_record_by_entity(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    won = F.col("result") == "W"
    return perspectives(spark, sf).groupBy("entity").agg(
        n(won).alias("wins"), n(F.col("result") == "L").alias("losses"), n(F.col("result") == "D").alias("draws"), n(won & (F.col("method") == "ko")).alias("ko_wins"),
        F.countDistinct(F.when(won, F.col("opponent"))).alias("beaten"), F.round(n(won) / F.count("*"), 6).alias("win_rate"),
    )


@query(CONTEST + f"""
SELECT entity, count(*) AS n, round(sum(w * CASE result WHEN 'W' THEN 100 WHEN 'D' THEN 50 ELSE 0 END) / sum(w), 6) AS form
FROM (SELECT *, ({FORM_WEIGHTS})[rn] AS w FROM (SELECT *, {RECENT} FROM side) WHERE rn <= 5) GROUP BY entity""")
def q_recent_form(spark, sf):
    last = H.last_n(perspectives(spark, sf), "entity", ORDER, 5)
    w = F.element_at(F.array(*map(F.lit, FORM_WEIGHTS)), F.col("rn"))
    points = F.when(F.col("result") == "W", 100).when(F.col("result") == "D", 50).otherwise(0)
    return last.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum(w * points) / F.sum(w), 6).alias("form"))


@query(CONTEST + f" SELECT entity, contest_id, CAST(rn AS INTEGER) AS rn, opponent FROM (SELECT *, {RECENT} FROM side) WHERE rn <= 3")
def q_last_n_filter(spark, sf):
    return H.last_n(perspectives(spark, sf), "entity", ORDER, 3).select("entity", "contest_id", "rn", "opponent")


@query(CONTEST + """, g AS (
  SELECT entity, result, row_number() OVER (PARTITION BY entity ORDER BY day, contest_id) - row_number() OVER (PARTITION BY entity, result ORDER BY day, contest_id) AS island,
         row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS rn FROM side WHERE result <> 'D'
), c AS (SELECT entity, result, island FROM g WHERE rn = 1)
SELECT g.entity, g.result, count(*) AS n FROM g JOIN c ON g.entity = c.entity AND g.result = c.result AND g.island = c.island GROUP BY ALL""")
def q_current_streak(spark, sf):
    decided = perspectives(spark, sf).where("result <> 'D'")
    return H.current_streaks(decided, "entity", ORDER, "result")


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
g AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS anchor FROM d)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, anchor, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id""")
def q_day_streak(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return H.day_runs(days, "user_id", "day")


BEST = "CASE WHEN result = 'W' THEN 12 + CASE WHEN method = 'ko' THEN 5 WHEN method = 'submission' THEN 5 ELSE 0 END + CASE WHEN scheduled = 5 THEN 4 ELSE 0 END ELSE 0 END"


@query(CONTEST + f"""
SELECT entity, CAST(least(100, max(s)) AS DOUBLE) AS best FROM (
  SELECT entity, sum({BEST}) OVER w AS s, count(*) OVER w AS m FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE m = 5 GROUP BY entity""")
def q_best_window5(spark, sf):
    points = 12 + F.when(F.col("method").isin("ko", "submission"), 5).otherwise(0) + F.when(F.col("scheduled") == 5, 4).otherwise(0)
    return H.best_window(perspectives(spark, sf), "entity", ORDER, F.when(F.col("result") == "W", points).otherwise(0), 5)


@query(CONTEST + """
SELECT entity, contest_id, count(*) OVER w AS bouts, coalesce(count(*) FILTER (result = 'W') OVER w, 0) AS wins, round(coalesce(sum(purse) OVER w, 0), 4) AS purse,
       round(max(purse) OVER w, 4) AS top_purse, round(min(purse) OVER w, 4) AS least_purse
FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_running_totals_pre(spark, sf):
    w = H.before("entity", *ORDER)
    return perspectives(spark, sf).select(
        "entity", "contest_id", F.count("*").over(w).alias("bouts"), F.count(F.when(F.col("result") == "W", 1)).over(w).alias("wins"),
        F.round(F.coalesce(F.sum("purse").over(w), F.lit(0.0)), 4).alias("purse"), F.round(F.max("purse").over(w), 4).alias("top_purse"), F.round(F.min("purse").over(w), 4).alias("least_purse"),
    )


@query(CONTEST + """
SELECT entity, contest_id, CAST(day - lag(day) OVER w AS BIGINT) AS layoff, CAST(day - min(day) OVER (PARTITION BY entity) AS BIGINT) AS tenure
FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id)""")
def q_layoff_days(spark, sf):
    w = H.timeline("entity", *ORDER)
    return perspectives(spark, sf).select("entity", "contest_id", F.datediff("day", F.lag("day").over(w)).cast("long").alias("layoff"), F.datediff("day", F.min("day").over(Window.partitionBy("entity"))).cast("long").alias("tenure"))


@query(CONTEST + """, c AS (
  SELECT *, CASE WHEN result IS NOT DISTINCT FROM lag(result) OVER (PARTITION BY entity ORDER BY day, contest_id) THEN 0 ELSE 1 END AS change FROM side
), i AS (SELECT *, sum(change) OVER (PARTITION BY entity ORDER BY day, contest_id) AS island FROM c)
SELECT entity, contest_id, CASE result WHEN 'W' THEN k WHEN 'L' THEN -k ELSE 0 END AS streak
FROM (SELECT *, row_number() OVER (PARTITION BY entity, island ORDER BY day, contest_id) AS k FROM i)""")
def q_signed_streak(spark, sf):
    i = H.islands(perspectives(spark, sf), "entity", ORDER, "result")
    k = F.row_number().over(H.timeline(["entity", "island"], *ORDER)).cast("long")
    return i.select("entity", "contest_id", H.signed_streak(F.col("result"), k).cast("long").alias("streak"))


@query(CONTEST + """, p AS (SELECT entity, day, purse, max(purse) OVER (PARTITION BY entity) AS peak FROM side),
f AS (SELECT entity, any_value(peak) AS peak, min(day) FILTER (purse = peak) AS first_peak FROM p GROUP BY entity)
SELECT p.entity, round(f.peak, 4) AS peak, f.first_peak, min(p.day) FILTER (p.day > f.first_peak AND p.purse < 0.5 * f.peak) AS first_dip, count(*) FILTER (p.day > f.first_peak) AS after
FROM p JOIN f ON p.entity = f.entity GROUP BY ALL""")
def q_peak_segment(spark, sf):
    every = Window.partitionBy("entity")
    p = perspectives(spark, sf).withColumn("peak", F.max("purse").over(every))
    p = p.withColumn("first_peak", F.min(F.when(F.col("purse") == F.col("peak"), F.col("day"))).over(every))
    later = F.col("day") > F.col("first_peak")
    return p.groupBy("entity").agg(
        F.round(F.first("peak"), 4).alias("peak"), F.first("first_peak").alias("first_peak"),
        F.min(F.when(later & (F.col("purse") < 0.5 * F.col("peak")), F.col("day"))).alias("first_dip"), F.count(F.when(later, 1)).alias("after"),
    )


@query(CONTEST + """, n AS (SELECT entity, contest_id, day, lead(day) OVER (PARTITION BY entity ORDER BY day, contest_id) AS nxt FROM side),
m AS (SELECT entity, contest_id, unnest(generate_series(date_trunc('month', day + INTERVAL 1 MONTH), nxt - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month FROM n WHERE nxt IS NOT NULL)
SELECT entity, contest_id, CAST(month AS DATE) AS month FROM m""")
def q_monthly_densify(spark, sf):
    p = perspectives(spark, sf).select("entity", "contest_id", "day")
    nxt = F.lead("day").over(H.timeline("entity", *ORDER))
    first, last = F.trunc(F.add_months("day", 1), "MM"), F.date_sub(F.col("nxt"), 1)
    gaps = p.withColumn("nxt", nxt).where(F.col("nxt").isNotNull() & (last >= first))
    return gaps.select("entity", "contest_id", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))


AGE = "((SELECT as_of FROM as_of) - day) / 365.25"
DECAY_SQL = f"CASE WHEN {AGE} < 1 THEN 1.0 WHEN {AGE} < 3 THEN 1.0 + ({AGE} - 1) * (0.3 - 1.0) / 2 WHEN {AGE} < 5 THEN 0.3 + ({AGE} - 3) * (0.1 - 0.3) / 2 ELSE 0.1 END"


@query(CONTEST + f"""
SELECT entity, round(sum(w * purse) / sum(w), 4) AS mean_purse, round(sum(w * CASE WHEN result = 'W' THEN 1 ELSE 0 END) / sum(w), 6) AS win_share
FROM (SELECT *, {DECAY_SQL} AS w FROM side) GROUP BY entity""")
def q_decay_weighted(spark, sf):
    w = S.decay(S.years_between(as_of(), F.col("day")))
    won = F.when(F.col("result") == "W", 1.0).otherwise(0.0)
    return perspectives(spark, sf).groupBy("entity").agg(F.round(F.sum(w * F.col("purse")) / F.sum(w), 4).alias("mean_purse"), F.round(F.sum(w * won) / F.sum(w), 6).alias("win_share"))


@query(CONTEST + " SELECT entity, CAST(least(100, sum(CASE WHEN result = 'W' THEN round ELSE 0 END) * 5) AS BIGINT) AS points FROM side GROUP BY entity")
def q_capped_sum(spark, sf):
    return perspectives(spark, sf).groupBy("entity").agg(F.least(F.lit(100), F.sum(F.when(F.col("result") == "W", F.col("round")).otherwise(0)) * 5).cast("long").alias("points"))


@query(CONTEST + """
SELECT division, count(*) AS n, count(*) FILTER (method IN ('ko', 'submission')) AS finishes, round(avg(purse) FILTER (winner_id IS NOT NULL), 4) AS mean_purse,
       round(max(purse) FILTER (method = 'decision'), 4) AS top_decision, count(DISTINCT a_id) FILTER (winner_id = a_id) AS winning_a,
       round(sum(purse) / nullif(count(*) FILTER (method IS NULL), 0), 4) AS per_unknown FROM contest GROUP BY division""")
def q_filtered_aggs(spark, sf):
    from .base import contests

    fin, dec = F.col("method").isin("ko", "submission"), F.col("method") == "decision"
    return contests(spark, sf).groupBy("division").agg(
        F.count("*").alias("n"), F.count(F.when(fin, 1)).alias("finishes"), F.round(F.avg(F.when(F.col("winner_id").isNotNull(), F.col("purse"))), 4).alias("mean_purse"),
        F.round(F.max(F.when(dec, F.col("purse"))), 4).alias("top_decision"), F.countDistinct(F.when(F.col("winner_id") == F.col("a_id"), F.col("a_id"))).alias("winning_a"),
        F.round(S.safe_ratio(F.sum("purse"), F.count(F.when(F.col("method").isNull(), 1))), 4).alias("per_unknown"),
    )


@query(CONTEST + "SELECT entity, count(DISTINCT division) AS divisions, count(DISTINCT opponent) FILTER (result = 'L') AS lost_to FROM side GROUP BY entity HAVING count(*) >= 10")
def q_distinct_filtered(spark, sf):
    g = perspectives(spark, sf).groupBy("entity").agg(F.countDistinct("division").alias("divisions"), F.countDistinct(F.when(F.col("result") == "L", F.col("opponent"))).alias("lost_to"), F.count("*").alias("n"))
    return g.where("n >= 10").drop("n")


@query(CONTEST + """
SELECT entity, count(*) FILTER (day >= as_of - INTERVAL 12 MONTH) AS n12, count(*) FILTER (day >= as_of - INTERVAL 24 MONTH) AS n24, count(*) FILTER (day >= as_of - INTERVAL 36 MONTH) AS n36
FROM side, as_of GROUP BY entity""")
def q_activity_windows(spark, sf):
    n = lambda m: F.count(F.when(F.col("day") >= S.months_ago(as_of(), m), 1)).alias(f"n{m}")
    return perspectives(spark, sf).groupBy("entity").agg(n(12), n(24), n(36))


@query(CONTEST + """
SELECT entity, contest_id, round(m3 - m, 6) AS trend FROM (
  SELECT entity, contest_id, avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
         avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
         count(*) OVER (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM side) WHERE n >= 2""")
def q_trend_vs_career(spark, sf):
    won = F.when(F.col("result") == "W", 1.0).otherwise(0.0)
    w, w3 = H.before("entity", *ORDER), H.timeline("entity", *ORDER).rowsBetween(-3, -1)
    d = perspectives(spark, sf).select("entity", "contest_id", (F.avg(won).over(w3) - F.avg(won).over(w)).alias("t"), F.count("*").over(w).alias("n"))
    return d.where("n >= 2").select("entity", "contest_id", F.round("t", 6).alias("trend"))


@query(CONTEST + """
SELECT entity, CAST(coalesce(min(rn) FILTER (result <> 'W') - 1, count(*)) AS BIGINT) AS run FROM (
  SELECT entity, result, row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS rn FROM side) GROUP BY entity""")
def q_leading_run(spark, sf):
    w = Window.partitionBy("entity").orderBy(F.desc("day"), F.desc("contest_id"))
    d = perspectives(spark, sf).withColumn("rn", F.row_number().over(w))
    return d.groupBy("entity").agg(F.coalesce(F.min(F.when(F.col("result") != "W", F.col("rn"))) - 1, F.count("*")).cast("long").alias("run"))


@query(CONTEST + """
SELECT contest_id, coalesce((round - 1) * 300 + coalesce(seconds, 300), scheduled * 300) AS elapsed,
       CASE WHEN method = 'decision' THEN false WHEN method IN ('ko', 'submission') THEN true ELSE NOT (round >= scheduled AND seconds >= 280) END AS finish FROM contest""")
def q_elapsed_and_finish(spark, sf):
    from .base import contests

    late = (F.col("round") >= F.col("scheduled")) & (F.col("seconds") >= 280)
    finish = F.when(F.col("method") == "decision", False).when(F.col("method").isin("ko", "submission"), True).otherwise(~late)
    return contests(spark, sf).select("contest_id", S.elapsed_seconds(F.col("round"), F.col("seconds"), F.col("scheduled")).alias("elapsed"), finish.alias("finish"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, day, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS BIGINT) AS last7 FROM d""")
def q_trailing_range(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).count()
    w = Window.partitionBy("user_id").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-7, -1)
    return d.select("user_id", "day", F.sum("count").over(w).alias("last7"))


SIZES = [25, 50, 100, 400, 1_000_000]


@query(CONTEST + f"""
, r AS (SELECT entity, row_number() OVER (ORDER BY count(*) DESC, entity) AS rank FROM side GROUP BY entity),
h AS (SELECT n AS size, contest_id, day, a_id, b_id FROM contest JOIN r a ON a.entity = a_id JOIN r b ON b.entity = b_id, (SELECT unnest({SIZES}) AS n) WHERE n >= greatest(a.rank, b.rank)),
s AS (SELECT size, contest_id, row_number() OVER (PARTITION BY size, e ORDER BY day, contest_id) - 1 AS seen FROM (SELECT *, unnest([a_id, b_id]) AS e FROM h)),
m AS (SELECT size, contest_id, min(seen) AS seen FROM s GROUP BY ALL)
SELECT size, count(*) AS held, count(*) FILTER (seen >= 3) AS testable FROM m GROUP BY size""")
def q_testable_contests(spark, sf):
    """What the contests between the entities with most contests would allow to test, for a few numbers of these."""
    counts = perspectives(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one")).withColumn("fewer", -F.col("n"))
    ranks = sums_before(counts, [], ["fewer", "entity"], ["one"]).select("entity", (F.col("before_one") + 1).alias("rank"))
    return H.testable(contests(spark, sf), ranks, SIZES, ["day", "contest_id"], 3)
