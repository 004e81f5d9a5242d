"""Ratings: opponents' tiers in two passes, score composites, pedigree, eras and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof, replay
from ..operators import history as H
from .base import AS_OF, contests, perspectives, table
from .lookups import REIGN, SNAP, board, reigns
from .registry import query

ORDER = ["day", "contest_id"]
#: Tier of an opponent: holders of a reign, those ever on the board, and those who beat a holder.
TIERS = SNAP + REIGN[REIGN.index(", q AS ("):] + """
, base AS (
  SELECT s.*, CASE WHEN opponent IN (SELECT holder FROM reign) THEN 25 WHEN opponent IN (SELECT entity FROM board) THEN 15 ELSE 0 END AS tier0 FROM side s
), eligible AS (SELECT DISTINCT entity FROM base WHERE result = 'W' AND tier0 = 25),
tiered AS (SELECT base.*, CASE WHEN tier0 = 0 AND opponent IN (SELECT entity FROM eligible) THEN 3 ELSE tier0 END AS tier FROM base)"""


def tiered(spark, sf):
    """Sides with the tier of the opponent. The second pass looks at who beat the best of the first."""
    holders = reigns(spark, sf).select(F.col("holder").alias("opponent"), F.lit(25).alias("h")).distinct()
    ranked = board(spark, sf).select(F.col("entity").alias("opponent"), F.lit(15).alias("r")).distinct()
    base = perspectives(spark, sf).join(holders, "opponent", "left").join(ranked, "opponent", "left").withColumn("tier0", F.coalesce("h", "r", F.lit(0))).drop("h", "r")
    eligible = base.where("result = 'W' and tier0 = 25").select(F.col("entity").alias("opponent"), F.lit(3).alias("e")).distinct()
    return base.join(eligible, "opponent", "left").withColumn("tier", F.when((F.col("tier0") == 0) & F.col("e").isNotNull(), 3).otherwise(F.col("tier0"))).drop("e")


@query(TIERS + " SELECT contest_id, entity, CAST(tier AS INTEGER) AS tier FROM tiered")
def q_opponent_tier_two_pass(spark, sf):
    return tiered(spark, sf).select("contest_id", "entity", "tier")


@query(TIERS + """
SELECT entity, CAST(least(100, sum(CASE WHEN result = 'W' THEN tier ELSE 0 END)) + CASE WHEN count(*) FILTER (result = 'W') >= 8 AND count(*) FILTER (result = 'L') = 0 THEN 30 ELSE 0 END AS BIGINT) AS quality,
       count(*) FILTER (result = 'W' AND tier = 25) AS apex_wins, round(avg(tier), 6) AS mean_tier FROM tiered GROUP BY entity""")
def q_opponent_quality(spark, sf):
    won = F.col("result") == "W"
    n = lambda c: F.count(F.when(c, 1))
    bonus = F.when((n(won) >= 8) & (n(F.col("result") == "L") == 0), 30).otherwise(0)
    quality = F.least(F.lit(100), F.sum(F.when(won, F.col("tier")).otherwise(0))) + bonus
    return tiered(spark, sf).groupBy("entity").agg(quality.cast("long").alias("quality"), n(won & (F.col("tier") == 25)).alias("apex_wins"), F.round(F.avg("tier"), 6).alias("mean_tier"))


YEARS = f"(DATE '{AS_OF}' - day) / 365.25"
DECAY = f"CASE WHEN {YEARS} < 1 THEN 1.0 WHEN {YEARS} < 3 THEN 1.0 + ({YEARS} - 1) * (0.3 - 1.0) / 2 WHEN {YEARS} < 5 THEN 0.3 + ({YEARS} - 3) * (0.1 - 0.3) / 2 ELSE 0.1 END"
FINISH = "coalesce(method IN ('ko', 'submission'), false)"


def _components(key: str) -> str:
    return f"""
, d AS (
  SELECT *, {DECAY} AS w, greatest(tier, 1) AS t1, row_number() OVER (PARTITION BY {key} ORDER BY day DESC, contest_id DESC) AS rn, least(1, greatest(0.6, 1 - tier / 30)) AS severity FROM tiered
), run AS (SELECT {key}, coalesce(min(rn) FILTER (result <> 'W') - 1, count(*)) AS streak FROM d GROUP BY {key}),
comp AS (
  SELECT {key}, count(*) AS bouts, least(100, coalesce(sum(w * tier) FILTER (result = 'W'), 0)) AS qw,
         coalesce(sum(w * t1) FILTER (result = 'W' AND {FINISH}) / sum(w * t1) FILTER (result = 'W'), 0) * 100 AS fin,
         least(100, greatest(coalesce(sum(t1) FILTER (day >= DATE '{AS_OF}' - INTERVAL 12 MONTH), 0) / 60, coalesce(sum(t1) FILTER (day >= DATE '{AS_OF}' - INTERVAL 24 MONTH), 0) / 120, coalesce(sum(t1) FILTER (day >= DATE '{AS_OF}' - INTERVAL 36 MONTH), 0) / 180) * 100) AS act,
         sum(([2.0, 1.5, 1.0, 0.75, 0.5])[rn] * CASE result WHEN 'W' THEN 100 WHEN 'D' THEN 50 ELSE 0 END) FILTER (rn <= 5) / sum(([2.0, 1.5, 1.0, 0.75, 0.5])[rn]) FILTER (rn <= 5) AS form,
         least(100, round(25 * coalesce(sum(severity) FILTER (result = 'L' AND rn <= 3), 0) + 12 * coalesce(sum(severity) FILTER (result = 'L' AND rn <= 5), 0) + 6 * coalesce(sum(severity) FILTER (result = 'L' AND day >= DATE '{AS_OF}' - INTERVAL 24 MONTH), 0) + 1e-9)) AS loss,
         count(*) FILTER (result = 'L' AND rn <= 3) AS l3, count(*) FILTER (result = 'L' AND rn <= 5) AS l5, count(*) FILTER (result = 'L' AND rn <= 2) AS l2, count(*) FILTER (result = 'L' AND rn = 1) AS l1,
         least(15, greatest(0, ((DATE '{AS_OF}' - max(day)) / 30.4375 - 12) * 0.5)) AS layoff, max(day) AS last_day
  FROM d GROUP BY {key}
), scored AS (
  SELECT comp.*, greatest(0, (0.16 * qw + 0.10 * fin + 0.12 * act + 0.18 * form - 0.20 * loss - layoff + least(5, greatest(0, streak - 2))) * least(1, 0.85 + 0.15 * least(1, bouts / 12))) AS raw FROM comp JOIN run USING ({key})
)"""


CURVE = "round(CASE WHEN raw < 0 THEN 0 WHEN raw < 25 THEN 0 + (raw - 0) * ((25 - 0) / 25) WHEN raw < 45 THEN 25 + (raw - 25) * ((60 - 25) / 20) WHEN raw < 60 THEN 60 + (raw - 45) * ((80 - 60) / 15) WHEN raw < 75 THEN 80 + (raw - 60) * ((93 - 80) / 15) WHEN raw < 88 THEN 93 + (raw - 75) * ((100 - 93) / 13) ELSE 100 END + 1e-9)"
SKID = "CASE WHEN l3 = 3 THEN 25 WHEN l5 >= 3 THEN 15 WHEN l3 >= 2 THEN 10 WHEN l1 = 1 THEN 5 ELSE 0 END"
CURRENT = "SELECT {0}, bouts, round(raw + 1e-9, 6) AS raw, CAST(greatest(0, " + CURVE + " - " + SKID + ") AS BIGINT) AS score FROM scored WHERE bouts >= {1}"


def components(sides, key: list[str]):
    """Components of each key's history as of AS_OF."""
    as_of, day = F.lit(AS_OF).cast("date"), F.col("day")
    from pyspark.sql import Window

    d = sides.withColumns(
        {
            "w": S.decay(S.years_between(as_of, day)), "t1": F.greatest("tier", F.lit(1)), "severity": F.least(F.lit(1.0), F.greatest(F.lit(0.6), 1 - F.col("tier") / 30)),
            "rn": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("day"), F.desc("contest_id"))),
        }
    )
    won, lost = F.col("result") == "W", F.col("result") == "L"
    fin = F.coalesce(F.col("method").isin("ko", "submission"), F.lit(False))
    total = lambda x, c: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    w5 = F.element_at(F.array(*map(F.lit, (2.0, 1.5, 1.0, 0.75, 0.5))), F.least("rn", F.lit(5)))
    last5, points = F.col("rn") <= 5, F.when(won, 100).when(lost, 0).otherwise(50)
    recent = lambda m: day >= S.months_ago(as_of, m)
    hit = F.round(25 * total(F.col("severity"), lost & (F.col("rn") <= 3)) + 12 * total(F.col("severity"), lost & last5) + 6 * total(F.col("severity"), lost & recent(24)) + 1e-9)
    return d.groupBy(*key).agg(
        F.count("*").alias("bouts"), F.least(F.lit(100.0), total(F.col("w") * F.col("tier"), won)).alias("qw"),
        (F.coalesce(F.try_divide(F.sum(F.when(won & fin, F.col("w") * F.col("t1"))), F.sum(F.when(won, F.col("w") * F.col("t1")))), F.lit(0.0)) * 100).alias("fin"),
        F.least(F.lit(100.0), F.greatest(*[total(F.col("t1"), recent(m)) / x for m, x in ((12, 60), (24, 120), (36, 180))]) * 100).alias("act"),
        (F.sum(F.when(last5, w5 * points)) / F.sum(F.when(last5, w5))).alias("form"), F.least(F.lit(100.0), hit).alias("loss"),
        n(lost & (F.col("rn") <= 3)).alias("l3"), n(lost & last5).alias("l5"), n(lost & (F.col("rn") == 1)).alias("l1"),
        S.layoff_penalty(S.months_mean(as_of, F.max("day"))).alias("layoff"), F.coalesce(F.min(F.when(~won, F.col("rn"))) - 1, F.count("*")).alias("streak"),
    )


def settled(raw, least: int, key: list[str], c):
    """The curve of a weighted sum and what a skid takes off."""
    c = c.withColumn("raw", raw)
    skid = F.when(F.col("l3") == 3, 25).when(F.col("l5") >= 3, 15).when(F.col("l3") >= 2, 10).when(F.col("l1") == 1, 5).otherwise(0)
    curve = F.round(S.polyline(F.col("raw"), S.SCORE) + 1e-9)
    return c.where(F.col("bouts") >= least).select(*key, "bouts", F.round(F.col("raw") + 1e-9, 6).alias("raw"), F.greatest(F.lit(0), curve - skid).cast("long").alias("score"))


def scored(sides, key: list[str], least: int):
    """What the results alone give: no titles, no statistics and no age."""
    weighted = 0.16 * F.col("qw") + 0.10 * F.col("fin") + 0.12 * F.col("act") + 0.18 * F.col("form") - 0.20 * F.col("loss") - F.col("layoff") + S.clamp(F.col("streak") - 2, 0, 5)
    return settled(F.greatest(F.lit(0.0), weighted * S.credibility(F.col("bouts"))), least, key, components(sides, key))


@query(TIERS + _components("entity") + CURRENT.format("entity", 5))
def q_score_current(spark, sf):
    return scored(tiered(spark, sf), ["entity"], 5)


@query(TIERS + _components("entity, division") + CURRENT.format("entity, division", 3))
def q_score_divisional(spark, sf):
    return scored(tiered(spark, sf), ["entity", "division"], 3)


@query(TIERS + f"""
, b AS (SELECT entity, s, m FROM (SELECT entity, sum(CASE WHEN result = 'W' THEN 12 + CASE WHEN {FINISH} THEN 5 ELSE 0 END ELSE 0 END) OVER w AS s, count(*) OVER w AS m FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE m = 5),
peak AS (SELECT entity, least(100, max(s)) AS peak FROM b GROUP BY entity),
c AS (
  SELECT entity, count(*) AS bouts, least(100, sum(CASE WHEN result = 'W' THEN tier ELSE 0 END)) AS qw, coalesce(count(*) FILTER (result = 'W' AND {FINISH}) / nullif(count(*) FILTER (result = 'W'), 0), 0) * 100 AS fin,
         least(100, 10 * coalesce(sum(least(1, greatest(0.35, 1 - tier / 30))) FILTER (result = 'L'), 0)) AS loss, least(100, 10 * count(*) FILTER (scheduled = 5)) AS era FROM tiered GROUP BY entity)
SELECT entity, round((0.24 * qw + 0.18 * era + 0.16 * fin + 0.10 * coalesce(peak, 0) - 0.10 * loss) * least(1, 0.62 + 0.38 * bouts / 14), 6) AS score FROM c LEFT JOIN peak USING (entity) WHERE bouts >= 3""")
def q_score_all_time(spark, sf):
    t = tiered(spark, sf)
    won, fin = F.col("result") == "W", F.coalesce(F.col("method").isin("ko", "submission"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    peak = H.best_window(t, "entity", ORDER, F.when(won, 12 + F.when(fin, 5).otherwise(0)).otherwise(0), 5)
    loss = F.sum(F.when(F.col("result") == "L", F.least(F.lit(1.0), F.greatest(F.lit(0.35), 1 - F.col("tier") / 30))))
    c = t.groupBy("entity").agg(
        F.count("*").alias("bouts"), F.least(F.lit(100), F.sum(F.when(won, F.col("tier")).otherwise(0))).alias("qw"), (S.safe_ratio(n(won & fin), n(won), 0.0) * 100).alias("fin"),
        F.least(F.lit(100.0), 10 * F.coalesce(loss, F.lit(0.0))).alias("loss"), F.least(F.lit(100), 10 * n(F.col("scheduled") == 5)).alias("era"),
    )
    score = (0.24 * F.col("qw") + 0.18 * F.col("era") + 0.16 * F.col("fin") + 0.10 * F.coalesce("best", F.lit(0.0)) - 0.10 * F.col("loss")) * S.career_credibility(F.col("bouts"))
    return c.where("bouts >= 3").join(peak, "entity", "left").select("entity", F.round(score, 6).alias("score"))


@query(REIGN + f"""
SELECT holder AS entity, count(*) AS reigns, count(*) FILTER (finish IS NULL) AS open_reigns, count(DISTINCT division) AS divisions, CAST(sum(coalesce(finish, DATE '{AS_OF}') - start) AS BIGINT) AS days,
       CAST(CASE WHEN count(*) FILTER (finish IS NULL) > 0 THEN 100 WHEN max(finish) >= DATE '{AS_OF}' - INTERVAL 36 MONTH THEN 90 WHEN count(*) >= 3 THEN 80 ELSE 70 END AS INTEGER) AS pedigree FROM reign GROUP BY holder""")
def q_pedigree(spark, sf):
    as_of = F.lit(AS_OF).cast("date")
    n_open = F.count(F.when(F.col("finish").isNull(), 1))
    rank = F.when(n_open > 0, 100).when(F.max("finish") >= S.months_ago(as_of, 36), 90).when(F.count("*") >= 3, 80).otherwise(70)
    held = F.sum(F.datediff(F.coalesce("finish", as_of), F.col("start"))).cast("long")
    return reigns(spark, sf).groupBy(F.col("holder").alias("entity")).agg(F.count("*").alias("reigns"), n_open.alias("open_reigns"), F.countDistinct("division").alias("divisions"), held.alias("days"), rank.alias("pedigree"))


@query(REIGN + """
SELECT s.entity, count(*) AS title_contests, CAST(least(100, 10 * count(*)) AS BIGINT) AS dominance FROM side s JOIN reign r ON r.holder = s.entity AND s.division = r.division AND s.day >= r.start AND (r.finish IS NULL OR s.day <= r.finish) GROUP BY s.entity""")
def q_era_dominance(spark, sf):
    held = reigns(spark, sf).withColumnRenamed("holder", "entity")
    inside = asof.contained(perspectives(spark, sf).select("entity", "division", "day", "contest_id"), held, "day", "start", "finish", ["division", "entity"])
    return inside.groupBy("entity").agg(F.count("*").alias("title_contests"), F.least(F.lit(100), 10 * F.count("*")).cast("long").alias("dominance"))


@query(REIGN + """
SELECT entity, division, day, method FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS k FROM side WHERE result <> 'D') WHERE k = 1""")
def q_current_division(spark, sf):
    last = H.last_n(perspectives(spark, sf).where("result <> 'D'"), "entity", ORDER, 1)
    return last.select("entity", "division", "day", "method")


def decided(spark, sf):
    won = F.when(F.col("winner_id") == F.col("a_id"), 1).when(F.col("winner_id") == F.col("b_id"), 0)
    return contests(spark, sf).select("contest_id", "day", "a_id", "b_id", won.alias("won"))


@query()
def q_elo_replay(spark, sf):
    """Ratings in the order of contests: both sides of each move from what they had just before it."""
    r = replay.by_side(replay.elo(decided(spark, sf), ORDER), ["rating"])
    return r.select("contest_id", "entity", F.round("rating", 6).alias("before"), F.round("rating_after", 6).alias("after"))


@query()
def q_opponent_history(spark, sf):
    """What the opponents of each entity were rated before each of its contests: mean, last five, best, of those beaten; 1400 where there is none."""
    r = replay.by_side(replay.elo(decided(spark, sf), ORDER), ["rating"], ["day", "won", "a_id"])
    won = F.when(F.col("won") == (F.col("entity") == F.col("a_id")).cast("int"), 1.0).otherwise(0.0)
    w = H.before("entity", *ORDER)
    last5 = H.timeline("entity", *ORDER).rowsBetween(-5, -1)
    known = lambda c: F.round(F.coalesce(c, F.lit(1400.0)), 4)
    o = F.col("other_rating")
    return r.withColumn("w", won).select(
        "contest_id", "entity", known(F.avg(o).over(w)).alias("mean"), known(F.avg(o).over(last5)).alias("last5"), known(F.max(o).over(w)).alias("best"), known(F.avg(F.when(F.col("w") == 1, o)).over(w)).alias("beaten"),
        F.round(F.try_divide(F.sum(F.col("w") * o).over(w), F.sum(o).over(w)), 6).alias("rate"),
    )


@query()
def q_glicko_replay(spark, sf):
    """Ratings with deviations; the figure that queries use is the rating less two deviations."""
    r = replay.by_side(replay.glicko(decided(spark, sf), ORDER), ["rating", "rd"])
    return r.select("contest_id", "entity", F.round("rating", 4).alias("rating"), F.round("rd", 4).alias("rd"), F.round(F.col("rating") - 2 * F.col("rd"), 4).alias("low"))


@query()
def q_attack_defence(spark, sf):
    """Scores cut at their 99th percentile, against a league mean of all earlier days."""
    k = F.col("contest_id")
    c = contests(spark, sf).select("contest_id", "day", "a_id", "b_id", (k * 37 % 300 / 60).alias("a_raw"), (k * 53 % 300 / 60).alias("b_raw"))
    top = c.agg(F.percentile("a_raw", 0.99).alias("top"))
    c = c.join(F.broadcast(top)).select("contest_id", "day", "a_id", "b_id", F.least("a_raw", "top").alias("a_score"), F.least("b_raw", "top").alias("b_score"))
    league = replay.league_mean(c, "day", [F.col("a_score"), F.col("b_score")], 2.5)
    r = replay.by_side(replay.attack_defence(c.join(F.broadcast(league), "day"), ORDER), ["attack", "defence"])
    return r.select("contest_id", "entity", F.round("attack", 6).alias("attack"), F.round("defence", 6).alias("defence"))


@query("SELECT c_mktsegment, c_nationkey, c_custkey, place FROM (SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def q_boards(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")
