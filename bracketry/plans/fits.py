"""Regressions of several factors: how contests end, who wins on the cards, and weights that keep their signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import regression as R
from .registry import query
from .trials import CASE, PRE, forecasts, wide

CAUSES, DIVISIONS, ROUNDS = ("ko", "submission"), ("light", "middle", "heavy"), (2, 3, 4, 5)
HAZARD = [*DIVISIONS, *[f"round_{r}" for r in ROUNDS], "minute"]


def is_(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def periods(spark, sf):
    """A row for each begun minute of a contest and each cause: y is 1 where the cause ended it, at_risk the log of the seconds."""
    f = forecasts(spark, sf).withColumn("fin", (F.col("round") - 1) * 300 + F.col("seconds"))
    bins = f.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("fin"), F.lit(60))))
    named = bins.withColumns({d: is_(F.col("division") == d) for d in DIVISIONS} | {f"round_{r}": is_(F.floor(F.col("start") / 300) + 1 == r) for r in ROUNDS})
    timed = named.withColumns({"minute": F.col("start") % 300 / 60, "at_risk": F.log(F.least(F.lit(60), F.col("fin") + 1 - F.col("start")).cast("double"))})
    each = timed.withColumn("cause", F.explode(F.array(*map(F.lit, CAUSES))))
    return each.withColumn("y", is_((F.col("fin") < F.col("start") + 60) & F.coalesce(F.col("method") == F.col("cause"), F.lit(False))))


@query()
def q_hazard_fit(spark, sf):
    """Rates of two causes by division, round and minute: Poisson with the time at risk, over different designs with their counts."""
    fit = R.fit_glm(periods(spark, sf), "poisson", "y", HAZARD, ["cause"], offset="at_risk", pool=True)
    return R.coefficients(fit, ["cause"]).withColumn("value", F.round("value", 6))


@query(CASE + """
, b AS (SELECT division, method, (round - 1) * 300 + seconds AS fin, unnest(range(0, (round - 1) * 300 + seconds + 1, 60)) AS start FROM f),
e AS (SELECT division, CAST(start // 300 + 1 AS INTEGER) AS round, cause, CASE WHEN fin < start + 60 AND method = cause THEN 1 ELSE 0 END AS y FROM b, (SELECT unnest(['ko', 'submission']) AS cause))
SELECT cause, 'division' AS factor, division AS level, sum(y)::DOUBLE AS events, sum(y)::DOUBLE AS fitted FROM e GROUP BY cause, division
UNION ALL SELECT cause, 'round', CAST(round AS VARCHAR), sum(y)::DOUBLE, sum(y)::DOUBLE FROM e GROUP BY cause, round""")
def q_hazard_margins(spark, sf):
    """What the fit expects of each factor's levels: at the most likely coefficients that is what happened."""
    rows = periods(spark, sf)
    fit = R.fit_glm(rows, "poisson", "y", HAZARD, ["cause"], offset="at_risk", pool=True)
    seen = R.with_mean(rows, fit, "poisson", HAZARD, ["cause"], "at_risk")
    levels = F.array(*[F.struct(F.lit(f).alias("factor"), c.cast("string").alias("level")) for f, c in (("division", F.col("division")), ("round", (F.floor(F.col("start") / 300) + 1).cast("int")))])
    cells = seen.groupBy("cause", "division", "start").agg(F.sum("y").alias("y"), F.sum("mean").alias("mean"))
    each = cells.select("cause", F.inline(levels), "y", "mean")
    return each.groupBy("cause", "factor", "level").agg(F.sum("y").alias("events"), F.round(F.sum("mean"), 4).alias("fitted"))


SIDES = ["rate", "bouts", "layoff"]
GRID, WARMTHS = (0.01, 0.1, 1.0, 10.0), (0.5, 0.8, 1.0, 1.25, 2.0)
SPLIT = "1997-01-01"


def decisions(spark, sf):
    """Decided contests in both orders: differences of what the sides had before, scaled to about one."""
    c = wide(spark, sf).join(forecasts(spark, sf).where("method = 'decision'").select("contest_id", "division", "day", "y"), "contest_id")
    unit = {"rate": 1, "bouts": 10, "layoff": 365}
    ahead = [((F.col(f"{n}_a") - F.col(f"{n}_b")) / unit[n]).cast("double").alias(n) for n in SIDES]
    d = c.select("contest_id", "division", "day", F.col("y").cast("double").alias("y"), *ahead)
    return d.unionByName(d.select("contest_id", "division", "day", (1 - F.col("y")).alias("y"), *[(-F.col(n)).alias(n) for n in SIDES]))


@query()
def q_decision_fit(spark, sf):
    """A logistic model of decisions without a slot's advantage: the penalty and the temperature that later contests choose, fitted anew on all."""
    d = decisions(spark, sf)
    early, late = d.where(F.col("day") < SPLIT), d.where(F.col("day") >= SPLIT)
    each = lambda rows, name, values: rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    fits = R.fit_glm(each(early, "c", GRID), "logit", "y", SIDES, ["c"], penalty="c", intercept=False)
    judged = R.with_mean(each(late, "c", GRID), fits, "logit", SIDES, ["c"], intercept=False)
    loss = lambda p: F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))
    best = judged.groupBy("c").agg(loss(F.col("mean")).alias("loss")).agg(F.min_by("c", F.struct("loss", "c")).alias("best_c"))
    kept = judged.join(F.broadcast(best), F.col("c") == F.col("best_c"))
    warm = S.sigmoid(S.logit(F.col("mean")) / F.col("t"))
    chosen = each(kept, "t", WARMTHS).groupBy("best_c", "t").agg(loss(warm).alias("loss")).groupBy("best_c").agg(F.min(F.struct("loss", "t")).alias("b"))
    whole = R.fit_glm(each(d, "c", GRID).join(F.broadcast(best), F.col("c") == F.col("best_c")), "logit", "y", SIDES, ["c"], penalty="c", intercept=False)
    terms = R.coefficients(whole, ["c"]).join(F.broadcast(chosen), F.col("c") == F.col("best_c"))
    return terms.select(F.col("c").alias("penalty"), F.col("b.t").alias("temperature"), F.round("b.loss", 6).alias("loss"), "term", F.round("value", 6).alias("value"))


@query(CASE + " SELECT division, count(*) AS n, sum(y)::DOUBLE AS won, sum(y)::DOUBLE AS fitted FROM f GROUP BY division")
def q_logit_margins(spark, sf):
    """A logistic model with the divisions and two differences as factors expects as many wins of a division as there were."""
    d = wide(spark, sf).join(forecasts(spark, sf).select("contest_id", "division", "y"), "contest_id")
    d = d.withColumns({n: is_(F.col("division") == n) for n in DIVISIONS} | {"rate": F.col("rate_a") - F.col("rate_b"), "bouts": (F.col("bouts_a") - F.col("bouts_b")) / 10})
    terms = [*DIVISIONS, "rate", "bouts"]
    seen = R.with_mean(d, R.fit_glm(d, "logit", "y", terms), "logit", terms)
    return seen.groupBy("division").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("won"), F.round(F.sum("mean"), 4).alias("fitted"))


#: Each set of free coefficients of two, solved by hand; the best whose signs hold.
SIGNED = PRE + """
, d AS (SELECT rate_a - rate_b AS u, (bouts_a - bouts_b) / 10 AS v, CAST(winner_id = a_id AS DOUBLE) AS y FROM wide JOIN contest USING (contest_id) WHERE winner_id IS NOT NULL),
m AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(y) AS my, stddev_pop(u) AS su, stddev_pop(v) AS sv, count(*) AS n FROM d),
s AS (SELECT sum(((u - mu) / su) ** 2) + 2 AS uu, sum(((v - mv) / sv) ** 2) + 2 AS vv, sum((u - mu) / su * (v - mv) / sv) AS uv, sum((u - mu) / su * (y - my)) AS uy, sum((v - mv) / sv * (y - my)) AS vy FROM d, m),
o AS (SELECT unnest([{'bu': (uy * vv - vy * uv) / (uu * vv - uv * uv), 'bv': (vy * uu - uy * uv) / (uu * vv - uv * uv)}, {'bu': uy / uu, 'bv': 0}, {'bu': 0, 'bv': vy / vv}, {'bu': 0, 'bv': 0}]) AS b, * FROM s),
w AS (SELECT arg_min(b, b.bu ** 2 * uu / 2 + b.bv ** 2 * vv / 2 + b.bu * b.bv * uv - b.bu * uy - b.bv * vy) AS b FROM o WHERE b.bu <= 0 AND b.bv >= 0)
SELECT n, round(b.bu / su, 6) + 0 AS rate, round(b.bv / sv, 6) + 0 AS bouts, round(my - b.bu / su * mu - b.bv / sv * mv, 6) AS intercept FROM w, m"""


@query(SIGNED)
def q_signed_ridge(spark, sf):
    """Ridge with a penalty of 2, the first coefficient held to at most 0 and the second to at least 0."""
    d = wide(spark, sf).join(forecasts(spark, sf).select("contest_id", "y"), "contest_id")
    d = d.select("y", (F.col("rate_a") - F.col("rate_b")).alias("rate"), ((F.col("bouts_a") - F.col("bouts_b")) / 10).alias("bouts"))
    fit = R.fit_ridge(d, "y", ["rate", "bouts"], penalty=2.0, signs={"rate": -1, "bouts": 1})
    at = lambda i: F.round(F.get("coefs", F.lit(i)), 6) + 0
    return fit.select("n", at(1).alias("rate"), at(2).alias("bouts"), at(0).alias("intercept"))
