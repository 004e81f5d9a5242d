"""Whole score composites: results, titles, statistics and age, their parts, and how a score came about over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof
from ..operators import history as H
from . import ratings, rounds
from .base import AS_OF, perspectives
from .lookups import REIGN, reigns
from .ratings import CURVE, SKID, TIERS, _components
from .registry import query

ORDER = ["day", "contest_id"]
#: The statistics of the rounds, after contests, reigns and tiers are there.
STATS = ", stat AS (" + rounds.STAT.split(", stat AS (", 1)[1]
BASE = "CASE WHEN count(*) FILTER (finish IS NULL) > 0 THEN 100 WHEN max(finish) >= DATE '{0}' - INTERVAL 36 MONTH THEN 90 WHEN count(*) >= 3 THEN 80 ELSE 70 END".format(AS_OF)
TITLES = f"""
, title AS (SELECT DISTINCT s.entity, s.contest_id, s.day FROM side s JOIN reign r ON r.holder IN (s.entity, s.opponent) AND s.division = r.division AND s.day >= r.start AND (r.finish IS NULL OR s.day <= r.finish)),
held AS (SELECT holder AS entity, {BASE} AS base, max(finish) AS ended FROM reign GROUP BY holder),
last5 AS (SELECT entity, avg(tier) AS mean_tier, max(day) AS last_day FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS rn FROM tiered) WHERE rn <= 5 GROUP BY entity),
away AS (SELECT l.entity, coalesce(base, 0) AS base, (DATE '{AS_OF}' - ended) / 365.25 AS y, CASE WHEN mean_tier >= 18 THEN 20 WHEN mean_tier >= 10 THEN 12 WHEN mean_tier >= 5 THEN 5 ELSE 0 END AS bonus, last_day >= DATE '{AS_OF}' - INTERVAL 24 MONTH AS active FROM last5 l LEFT JOIN held USING (entity)),
cp AS (
  SELECT entity, base, active, CASE WHEN NOT active THEN NULL WHEN base NOT IN (70, 80) THEN base ELSE least(base, round(bonus + CASE
    WHEN base = 80 THEN CASE WHEN y < 0 THEN 80 WHEN y < 3 THEN 80 + (y - 0) * ((50 - 80) / 3) WHEN y < 8 THEN 50 + (y - 3) * ((25 - 50) / 5) ELSE 25 END
    ELSE CASE WHEN y < 1 THEN 70 WHEN y < 3 THEN 70 + (y - 1) * ((25 - 70) / 2) ELSE 25 END END + 1e-9)) END AS cp FROM away)"""


def title_contests(spark, sf):
    """(entity, contest_id, day) for both sides of contests in which either holds the division's reign."""
    s, held = perspectives(spark, sf).select("entity", "opponent", "division", "day", "contest_id"), reigns(spark, sf)
    inside = lambda who: asof.contained(s, held.withColumnRenamed("holder", who), "day", "start", "finish", ["division", who]).select("entity", "contest_id", "day")
    return inside("entity").unionAll(inside("opponent")).distinct()


def pedigrees(spark, sf):
    """(entity, base, active, cp): what reigns are worth, and what is left of it today, null for those not active."""
    today = F.lit(AS_OF).cast("date")
    rank = F.when(F.count(F.when(F.col("finish").isNull(), 1)) > 0, 100).when(F.max("finish") >= S.months_ago(today, 36), 90).when(F.count("*") >= 3, 80).otherwise(70)
    held = reigns(spark, sf).groupBy(F.col("holder").alias("entity")).agg(rank.alias("base"), F.max("finish").alias("ended"))
    last = H.last_n(ratings.tiered(spark, sf), "entity", ORDER, 5).groupBy("entity").agg(F.avg("tier").alias("mean_tier"), F.max("day").alias("last_day"))
    d = last.join(held, "entity", "left").withColumn("base", F.coalesce("base", F.lit(0))).withColumn("active", F.col("last_day") >= S.months_ago(today, 24))
    years = S.years_between(today, F.col("ended"))
    left = F.when(F.col("base") == 80, S.polyline(years, S.TITLE_DECAY)).otherwise(S.polyline(years, S.FORMER_TITLE_DECAY))
    now = F.when(~F.col("base").isin(70, 80), F.col("base").cast("double")).otherwise(F.least(F.col("base"), F.round(S.opponent_bonus(F.col("mean_tier")) + left + 1e-9)))
    return d.select("entity", "base", "active", F.when(F.col("active"), now).alias("cp"))


@query(TIERS + TITLES + " SELECT entity, CAST(base AS INTEGER) AS base, active, CAST(cp AS DOUBLE) AS cp FROM cp")
def q_current_pedigree(spark, sf):
    return pedigrees(spark, sf)


FIGHT = """
, own AS (SELECT contest_id, entity, sum(landed) AS landed, sum(attempted) AS attempted, sum(body) AS body, sum(legs) AS legs, sum(downs) AS downs FROM stat GROUP BY ALL),
fight AS (
  SELECT t.entity, t.contest_id, t.tier, (t.round - 1) * 300 + t.seconds AS secs, coalesce(o.landed, 0) AS landed, coalesce(o.body, 0) AS body, coalesce(o.legs, 0) AS legs,
         coalesce(p.landed, 0) AS absorbed, coalesce(p.attempted, 0) AS faced, coalesce(p.legs, 0) AS opp_legs, coalesce(p.downs, 0) AS opp_downs, row_number() OVER (PARTITION BY t.entity ORDER BY t.day DESC, t.contest_id DESC) AS rn
  FROM tiered t LEFT JOIN own o ON o.contest_id = t.contest_id AND o.entity = t.entity LEFT JOIN own p ON p.contest_id = t.contest_id AND p.entity = t.opponent
), recent AS (
  SELECT entity, avg(strike) AS strike, avg(CASE WHEN secs = 0 THEN 50.0 ELSE least(100, greatest(0, 50 + (body / secs * 60 - 15) * 2.6)) END) AS control, avg(least(100, greatest(0, 50 + coalesce((legs - opp_legs) / 10 * 900 / nullif(secs, 0) * 5, 0)))) AS grapple,
         avg(strike - least(90, 50 + (50 - least(50, tier * 2)))) AS adj FROM (SELECT *, least(100, greatest(0, 50 + coalesce((landed - absorbed) * 60 / nullif(secs, 0) * 20, 0))) AS strike FROM fight WHERE rn <= 5) GROUP BY entity
), dims AS (SELECT entity, least(100, greatest(0, strike + adj * 0.5)) AS s, least(100, greatest(0, control + adj * 0.3)) AS c, least(100, greatest(0, grapple)) AS g FROM recent),
perf AS (SELECT entity, least(100, greatest(s, c, g) * (1 + 0.25 * least(s, c, g) / greatest(greatest(s, c, g), 1))) AS perf FROM dims),
guard AS (
  SELECT entity, coalesce(sum(landed) * 60 / nullif(sum(secs), 0), 0) AS slpm, coalesce(sum(legs) / 10 * 900 / nullif(sum(secs), 0), 0) AS td, coalesce(1 - sum(opp_legs) / nullif(sum(opp_legs) + sum(body), 0), 0.55) AS td_def,
         coalesce(1 - sum(absorbed) / nullif(sum(faced), 0), 0.55) AS str_def, coalesce(sum(absorbed) * 60 / nullif(sum(secs), 0), 0) AS sapm, avg(opp_downs) / 20 AS kd FROM fight GROUP BY entity),
dv AS (SELECT entity, least(100, greatest(0, 100 * (least(1, slpm / 5) * greatest(0, 0.55 - td_def) / 0.55 + least(1, td / 2) * (0.45 * greatest(0, 0.55 - str_def) / 0.55 + 0.25 * least(1, greatest(0, sapm - 4) / 4) + 0.30 * least(1, greatest(0, kd - 0.15) / 0.25))))) AS dv FROM guard)"""


def fights(spark, sf):
    """Every side of every contest with the figures of both, its seconds and its opponent's tier."""
    own = rounds.stats(spark, sf).groupBy("contest_id", "entity").agg(*[F.sum(c).alias(c) for c in ("landed", "attempted", "body", "legs", "downs")])
    other = own.select("contest_id", F.col("entity").alias("opponent"), F.col("landed").alias("absorbed"), F.col("attempted").alias("faced"), F.col("legs").alias("opp_legs"), F.col("downs").alias("opp_downs"))
    d = ratings.tiered(spark, sf).join(own, ["contest_id", "entity"], "left").join(other, ["contest_id", "opponent"], "left")
    zero = {c: 0 for c in ("landed", "body", "legs", "absorbed", "faced", "opp_legs", "opp_downs")}
    return d.fillna(zero).withColumn("secs", (F.col("round") - 1) * 300 + F.col("seconds"))


def performance(fights):
    """(entity, perf): the best of three axes over the last five contests, lifted by the weakest."""
    f = H.last_n(fights, "entity", ORDER, 5)
    rate = lambda x, k: F.coalesce(F.try_divide(x * F.lit(float(k)), F.col("secs")), F.lit(0.0))
    strike = S.clamp(50 + rate(F.col("landed") - F.col("absorbed"), 60) * 20, 0.0, 100.0)
    control = F.when(F.col("secs") == 0, 50.0).otherwise(S.clamp(50 + (rate(F.col("body"), 60) - 15) * 2.6, 0.0, 100.0))
    grapple = S.clamp(50 + rate((F.col("legs") - F.col("opp_legs")) / 10, 900) * 5, 0.0, 100.0)
    expected = F.least(F.lit(90.0), 50 + (50 - F.least(F.lit(50.0), F.col("tier") * 2.0)))
    r = f.groupBy("entity").agg(F.avg(strike).alias("strike"), F.avg(control).alias("control"), F.avg(grapple).alias("grapple"), F.avg(strike - expected).alias("adj"))
    axes = [S.clamp(F.col("strike") + F.col("adj") * 0.5, 0.0, 100.0), S.clamp(F.col("control") + F.col("adj") * 0.3, 0.0, 100.0), S.clamp(F.col("grapple"), 0.0, 100.0)]
    top = F.greatest(*axes)
    return r.select("entity", F.least(F.lit(100.0), top * (1 + 0.25 * F.least(*axes) / F.greatest(top, F.lit(1.0)))).alias("perf"))


def vulnerability(fights):
    """(entity, dv): weak defence where the own style calls for it."""
    n = lambda c: F.sum(c)
    per = lambda c, k: F.coalesce(F.try_divide(n(c) * F.lit(float(k)), n("secs")), F.lit(0.0))
    g = fights.groupBy("entity").agg(
        per("landed", 60).alias("slpm"), (per("legs", 900) / 10).alias("td"), F.coalesce(1 - F.try_divide(n("opp_legs"), n("opp_legs") + n("body")), F.lit(0.55)).alias("td_def"),
        F.coalesce(1 - F.try_divide(n("absorbed"), n("faced")), F.lit(0.55)).alias("str_def"), per("absorbed", 60).alias("sapm"), (F.avg("opp_downs") / 20).alias("kd"),
    )
    weak = lambda c: F.greatest(F.lit(0.0), 0.55 - F.col(c)) / 0.55
    over = lambda c, least, width: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) - least) / width)
    one = F.lit(1.0)
    hurt = F.least(one, F.col("slpm") / 5) * weak("td_def") + F.least(one, F.col("td") / 2) * (0.45 * weak("str_def") + 0.25 * over("sapm", 4, 4) + 0.30 * over("kd", 0.15, 0.25))
    return g.select("entity", S.clamp(100 * hurt, 0.0, 100.0).alias("dv"))


AGED = f"(date_diff('month', make_date(CAST(1962 + entity % 22 AS INTEGER), 3, 1), DATE '{AS_OF}') // 12)"
WHOLE = TIERS + _components("entity").rsplit(", scored AS (", 1)[0] + TITLES + STATS + FIGHT + f"""
, tf AS (SELECT entity, count(*) FILTER (day >= DATE '{AS_OF}' - INTERVAL 24 MONTH) AS t24, count(*) FILTER (day >= DATE '{AS_OF}' - INTERVAL 36 MONTH) AS t36, count(*) AS titles FROM title GROUP BY entity),
whole AS (
  SELECT comp.*, streak, coalesce(cp, 0) AS cp, active, base, perf, dv, CASE WHEN t24 >= 1 THEN 50 ELSE 0 END + CASE WHEN t36 >= 2 THEN 50 ELSE 0 END AS era, coalesce(titles, 0) AS titles,
         CASE WHEN {AGED} < 26 THEN 0 WHEN {AGED} <= 30 THEN 0.05 WHEN {AGED} <= 32 THEN 0.02 WHEN {AGED} <= 34 THEN 0 WHEN {AGED} <= 36 THEN -0.04 WHEN {AGED} <= 38 THEN -0.08 ELSE -0.12 END AS age
  FROM comp JOIN run USING (entity) JOIN cp USING (entity) JOIN perf USING (entity) JOIN dv USING (entity) LEFT JOIN tf USING (entity)
), weighed AS (
  SELECT *, greatest(0, (0.16 * qw + 0.10 * cp + 0.06 * era + 0.16 * perf + 0.10 * fin + 0.12 * act + 0.18 * form - 0.20 * loss - 0.10 * dv - layoff + least(5, greatest(0, streak - 2))) * (1 + age) * least(1, 0.85 + 0.15 * least(1, bouts / 12))) AS raw FROM whole WHERE active)"""


def whole(spark, sf):
    """Every component of every entity."""
    today = F.lit(AS_OF).cast("date")
    f = fights(spark, sf)
    n = lambda m: F.count(F.when(F.col("day") >= S.months_ago(today, m), 1))
    tf = title_contests(spark, sf).groupBy("entity").agg(n(24).alias("t24"), n(36).alias("t36"), F.count("*").alias("titles"))
    born = F.make_date((1962 + F.col("entity") % 22).cast("int"), F.lit(3), F.lit(1))
    c = ratings.components(ratings.tiered(spark, sf), ["entity"]).join(pedigrees(spark, sf), "entity").join(performance(f), "entity").join(vulnerability(f), "entity").join(tf, "entity", "left")
    return c.withColumns({
        "cp": F.coalesce("cp", F.lit(0.0)), "titles": F.coalesce("titles", F.lit(0)), "age": S.age_factor(S.age_years(today, born)),
        "era": F.when(F.col("t24") >= 1, 50).otherwise(0) + F.when(F.col("t36") >= 2, 50).otherwise(0),
    })


#: The weights of the components of both scores.
CURRENT = {"qw": 0.16, "cp": 0.10, "era": 0.06, "perf": 0.16, "fin": 0.10, "act": 0.12, "form": 0.18, "loss": -0.20, "dv": -0.10}
EVER = {"qw_all": 0.24, "base": 0.20, "era_all": 0.18, "perf": 0.12, "fin_all": 0.16, "peak": 0.10, "loss_all": -0.10}


def weighed(weights):
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))


@query(WHOLE + f" SELECT entity, bouts, round(raw + 1e-9, 6) AS raw, CAST(greatest(0, {CURVE} - {SKID}) AS BIGINT) AS score FROM weighed WHERE bouts >= 5")
def q_score_whole(spark, sf):
    """The current score with titles, statistics, defence and age, for active entities of five contests and more."""
    inner = weighed(CURRENT) - F.col("layoff") + S.clamp(F.col("streak") - 2, 0, 5)
    raw = F.greatest(F.lit(0.0), inner * (1 + F.col("age")) * S.credibility(F.col("bouts")))
    return ratings.settled(raw, 5, ["entity"], whole(spark, sf).where("active"))


@query(WHOLE + """
, x AS (SELECT entity, unnest(['qw', 'cp', 'era', 'perf', 'fin', 'act', 'form', 'loss', 'dv']) AS component, unnest([0.16, 0.10, 0.06, 0.16, 0.10, 0.12, 0.18, -0.20, -0.10]::DOUBLE[]) AS weight, unnest([qw, cp, era, perf, fin, act, form, loss, dv]::DOUBLE[]) AS value FROM whole)
SELECT entity, component, weight, round(value, 6) AS value, round(weight * value, 6) AS points FROM x""")
def q_score_breakdown(spark, sf):
    """A row for each component: its weight, its value and what it adds."""
    each = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(w).alias("weight"), F.col(c).cast("double").alias("v")) for c, w in CURRENT.items()])
    return whole(spark, sf).select("entity", F.inline(each)).select("entity", "component", "weight", F.round("v", 6).alias("value"), F.round(F.col("weight") * F.col("v"), 6).alias("points"))


@query(WHOLE + f"""
, best AS (SELECT entity, sum(CASE WHEN result = 'W' THEN 12 + CASE WHEN coalesce(method IN ('ko', 'submission'), false) THEN 5 ELSE 0 END ELSE 0 END) OVER w AS s, count(*) OVER w AS m FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
peak AS (SELECT entity, least(100, max(s)) AS peak FROM best WHERE m = 5 GROUP BY entity),
c AS (SELECT entity, least(100, sum(CASE WHEN result = 'W' THEN tier ELSE 0 END)) AS qw_all, coalesce(count(*) FILTER (result = 'W' AND coalesce(method IN ('ko', 'submission'), false)) / nullif(count(*) FILTER (result = 'W'), 0), 0) * 100 AS fin_all,
             least(100, 10 * coalesce(sum(least(1, greatest(0.35, 1 - tier / 30))) FILTER (result = 'L'), 0)) AS loss_all FROM tiered GROUP BY entity)
SELECT entity, CAST(greatest(0, round((0.24 * qw_all + 0.20 * base + 0.18 * least(100, 10 * titles) + 0.12 * perf + 0.16 * fin_all + 0.10 * coalesce(peak, 0) - 0.10 * loss_all) * least(1, 0.62 + 0.38 * least(1, bouts / 14)) + 1e-9)) AS BIGINT) AS score
FROM whole JOIN c USING (entity) LEFT JOIN peak USING (entity) WHERE bouts >= 3""")
def q_score_all_time_whole(spark, sf):
    """The all-time score with pedigree, title contests, performance and peak."""
    t = ratings.tiered(spark, sf)
    won, fin = F.col("result") == "W", F.coalesce(F.col("method").isin("ko", "submission"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    peak = H.best_window(t, "entity", ORDER, F.when(won, 12 + F.when(fin, 5).otherwise(0)).otherwise(0), 5).withColumnRenamed("best", "peak")
    loss = F.sum(F.when(F.col("result") == "L", F.least(F.lit(1.0), F.greatest(F.lit(0.35), 1 - F.col("tier") / 30))))
    c = t.groupBy("entity").agg(F.least(F.lit(100), F.sum(F.when(won, F.col("tier")).otherwise(0))).alias("qw_all"), (S.safe_ratio(n(won & fin), n(won), 0.0) * 100).alias("fin_all"), F.least(F.lit(100.0), 10 * F.coalesce(loss, F.lit(0.0))).alias("loss_all"))
    d = whole(spark, sf).where("bouts >= 3").join(c, "entity").join(peak, "entity", "left").withColumn("peak", F.coalesce("peak", F.lit(0.0))).withColumn("era_all", F.least(F.lit(100), 10 * F.col("titles")))
    cred = F.least(F.lit(1.0), 0.62 + 0.38 * F.least(F.lit(1.0), F.col("bouts") / 14))
    return d.select("entity", F.greatest(F.lit(0), F.round(weighed(EVER) * cred + 1e-9)).cast("long").alias("score"))


#: Anchors of a history: after every contest, and the first of each month up to the next one.
HISTORY = REIGN + """, nxt AS (SELECT entity, contest_id, day, lead(day) OVER (PARTITION BY entity ORDER BY day, contest_id) AS nxt FROM side),
anchor AS (
  SELECT entity, contest_id, day AS dated, 'contest' AS kind FROM side
  UNION ALL SELECT entity, NULL, CAST(unnest(generate_series(date_trunc('month', day + INTERVAL 1 MONTH), nxt - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE), 'month' FROM nxt WHERE nxt IS NOT NULL
), h AS (
  SELECT a.entity, a.contest_id, a.dated, a.kind, count(*) AS bouts, sum(w) AS w, sum(w * points) AS wp FROM anchor a JOIN (SELECT entity, day, CASE result WHEN 'W' THEN 100 WHEN 'D' THEN 50 ELSE 0 END AS points FROM side) s ON s.entity = a.entity AND s.day <= a.dated,
  LATERAL (SELECT (a.dated - s.day) / 365.25 AS y) y, LATERAL (SELECT CASE WHEN y < 1 THEN 1.0 WHEN y < 3 THEN 1.0 + (y - 1) * (0.3 - 1.0) / 2 WHEN y < 5 THEN 0.3 + (y - 3) * (0.1 - 0.3) / 2 ELSE 0.1 END AS w) w GROUP BY ALL)"""


def histories(spark, sf):
    """(entity, contest_id, dated, kind, bouts, w, wp) for every anchor: the decayed sums of all contests up to it.

    The decay is made of straight lines in the age, so that each of its pieces is a window over a range of days with the sums
    of points and of points times days: no anchor is joined with the contests before it.
    """
    s = perspectives(spark, sf).select("entity", "contest_id", "day", F.when(F.col("result") == "W", 100).when(F.col("result") == "D", 50).otherwise(0).alias("points"))
    months = H.monthly(s.select("entity", "day").distinct(), "entity", "day").select("entity", F.lit(None).cast("long").alias("contest_id"), F.col("month").alias("day"), F.lit(None).cast("int").alias("points"), F.lit("month").alias("kind"))
    d = s.withColumn("kind", F.lit("contest")).unionByName(months).withColumn("n", F.datediff("day", F.lit("1970-01-01")).cast("long"))
    along = Window.partitionBy("entity").orderBy("n")
    held = F.col("points").isNotNull()
    one, x = F.when(held, F.lit(1).cast("long")), F.col("points").cast("long")
    # pieces of the decay as (first and last age in days, its value at age 0 and its fall a day), in units of 1 / 29220: whole
    # numbers throughout, so that no digits are lost between two large sums
    pieces = [(0, 365, 29220, 0), (366, 1095, 39447, 28), (1096, 1826, 17532, 8), (1827, None, 2922, 0)]
    w, wp = F.lit(0).cast("long"), F.lit(0).cast("long")
    for first, last, base, fall in pieces:
        own = along.rangeBetween(Window.unboundedPreceding if last is None else -last, -first)
        total = lambda c, own=own: F.coalesce(F.sum(c).over(own), F.lit(0).cast("long"))
        for weight in (1, 2):
            v = one if weight == 1 else x
            part = base * total(v) - fall * (F.col("n") * total(v) - total(v * F.col("n"))) if fall else base * total(v)
            w, wp = (w + part, wp) if weight == 1 else (w, wp + part)
    bouts = F.count(one).over(along.rangeBetween(Window.unboundedPreceding, 0))
    return d.select("entity", "contest_id", F.col("day").alias("dated"), "kind", bouts.alias("bouts"), w.alias("w"), wp.alias("wp"))


@query(HISTORY + " SELECT entity, contest_id, dated, kind, bouts, round(wp / w * least(1, 0.85 + 0.15 * bouts / 12) + 1e-9, 4) AS score FROM h")
def q_score_history(spark, sf):
    """A score after every contest and in every month between two, each from what was known then."""
    return histories(spark, sf).select("entity", "contest_id", "dated", "kind", "bouts", F.round(F.col("wp") / F.col("w") * S.credibility(F.col("bouts")) + 1e-9, 4).alias("score"))


@query(HISTORY + """
, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dated DESC, contest_id DESC) AS k FROM h WHERE kind = 'contest'), live AS (SELECT entity, avg(CASE result WHEN 'W' THEN 100.0 WHEN 'D' THEN 50 ELSE 0 END) AS live FROM side GROUP BY entity)
SELECT k.entity, contest_id, dated, round(CASE WHEN k = 1 THEN live ELSE wp / w END + 1e-9, 4) AS score, k = 1 AS live FROM k JOIN live USING (entity)""")
def q_score_timeline(spark, sf):
    """The history at contests, its last point replaced by the live figure."""
    points = F.when(F.col("result") == "W", 100.0).when(F.col("result") == "D", 50.0).otherwise(0.0)
    live = perspectives(spark, sf).groupBy("entity").agg(F.avg(points).alias("now"))
    h = histories(spark, sf).where("kind = 'contest'").withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("dated"), F.desc("contest_id"))))
    last = F.col("k") == 1
    return h.join(live, "entity").select("entity", "contest_id", "dated", F.round(F.when(last, F.col("now")).otherwise(F.col("wp") / F.col("w")) + 1e-9, 4).alias("score"), last.alias("live"))


