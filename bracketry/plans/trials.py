"""Forecasts judged: scores, calibration, splits, labels, hazards and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluate as E
from ..operators import history as H
from ..operators.twosided import differences, swapped, symmetrised
from .base import CONTEST, contests, perspectives, table
from .registry import query
from .rounds import CARD, by_contest, cards

#: A forecast for side a of every decided contest, by a rule over its key, and whether it came true.
CASE = CONTEST + """, f AS (
  SELECT contest_id, division, day, method, round, seconds, (contest_id * 7919 % 1000 + 0.5) / 1000 AS p, CAST(winner_id = a_id AS INTEGER) AS y FROM contest WHERE winner_id IS NOT NULL)"""


def forecasts(spark, sf):
    c = contests(spark, sf).where("winner_id is not null")
    return c.select("contest_id", "division", "day", "method", "round", "seconds", ((F.col("contest_id") * 7919 % 1000 + 0.5) / 1000).alias("p"), (F.col("winner_id") == F.col("a_id")).cast("int").alias("y"))


LOSS = "-(y * ln(least(0.9999, greatest(0.0001, p))) + (1 - y) * ln(1 - least(0.9999, greatest(0.0001, p))))"


@query(CASE + f"SELECT division, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg({LOSS}), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM f GROUP BY division")
def q_logloss_brier(spark, sf):
    s = E.scores(forecasts(spark, sf), "p", "y", ["division"])
    return s.select("division", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier")])


@query(CASE + """
, r AS (SELECT division, y, (rank() OVER (PARTITION BY division ORDER BY p)) + (count(*) OVER (PARTITION BY division, p) - 1) / 2.0 AS rk FROM f)
SELECT division, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY division""")
def q_auc(spark, sf):
    return E.auc(forecasts(spark, sf), "p", "y", "division").select("division", F.round("auc", 6).alias("auc"))


BINS = CASE + ", c AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM f GROUP BY 1)"


@query(BINS + "SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM c")
def q_bucket_table(spark, sf):
    return E.calibration(forecasts(spark, sf), "p", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(BINS + """, b AS (SELECT sum(n * rate) / sum(n) AS base FROM c)
SELECT round(sum(n * (mean_p - rate) ** 2) / sum(n), 6) AS reliability, round(sum(n * (rate - base) ** 2) / sum(n), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM c, b""")
def q_murphy(spark, sf):
    return E.murphy(forecasts(spark, sf), "p", "y").select(*[F.round(c, 6).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query(BINS + "SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM c")
def q_ece(spark, sf):
    return E.expected_error(forecasts(spark, sf), "p", "y").select(F.round("ece", 6).alias("ece"))


@query(CASE + """
, g AS (SELECT division, sum(y) / count(*) AS p, count(*) AS n FROM f GROUP BY division)
SELECT division, n, round((p + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 6) AS lo, round((p + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 6) AS hi FROM g""")
def q_wilson(spark, sf):
    g = forecasts(spark, sf).groupBy("division").agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    w = g.select("division", "n", E.wilson(F.col("hits"), F.col("n")).alias("w"))
    return w.select("division", "n", F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


@query(CASE + """
, o AS (SELECT CAST(unnest(generate_series(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 1 YEAR)) AS DATE) AS origin),
r AS (SELECT origin, y, p, CASE WHEN day < origin - 180 THEN 'train' WHEN day < origin THEN 'val' WHEN day < origin + 365 THEN 'test' END AS role FROM f, o)
SELECT origin, role, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM r WHERE role IS NOT NULL GROUP BY ALL""")
def q_walk_forward_splits(spark, sf):
    origins = spark.sql("select explode(sequence(date '1999-01-01', date '2001-01-01', interval 1 year)) as origin")
    r = E.walk_forward(forecasts(spark, sf), "day", origins, "origin", 180, 365)
    return r.groupBy("origin", "role").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'R' THEN 0.0 ELSE 0.5 END) AS m FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS rounds, count(*) FILTER (m > 0.5) AS first_side, count(*) FILTER (m = 0.5) AS even FROM v GROUP BY l_orderkey""")
def q_majority_vote(spark, sf):
    vote = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.0).otherwise(0.5)
    v = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg(vote).alias("m"))
    return v.groupBy("l_orderkey").agg(F.count("*").alias("rounds"), F.count(F.when(F.col("m") > 0.5, 1)).alias("first_side"), F.count(F.when(F.col("m") == 0.5, 1)).alias("even"))


@query(CARD + """
, per AS (SELECT contest_id, judge, avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END) AS share, sum(a - b) AS total, count(*) AS n FROM card GROUP BY contest_id, judge),
cards AS (SELECT contest_id, sum(share * n) / sum(n) AS rounds_a, avg(CASE WHEN total > 0 THEN 1.0 WHEN total = 0 THEN 0.5 ELSE 0 END) AS judges_a FROM per GROUP BY contest_id),
j AS (SELECT c.*, rounds_a, judges_a, CASE WHEN winner_id = a_id THEN 1 ELSE -1 END AS sign FROM contest c LEFT JOIN cards USING (contest_id)),
imp AS (SELECT avg(abs(2 * rounds_a - 1)) AS usual FROM j WHERE winner_id IS NOT NULL AND method = 'decision'),
m AS (SELECT *, 0.65 * coalesce(2 * rounds_a - 1, usual * sign) + 0.35 * abs(2 * coalesce(judges_a, 1) - 1) * sign AS margin, least(1, ((round - 1) * 300 + seconds) / (scheduled * 300)) AS t FROM j, imp),
w AS (SELECT *, CASE WHEN method IN ('ko', 'submission') THEN 0.95 - 0.10 * t WHEN method = 'decision' THEN 0.5 + 0.35 * margin * sign ELSE 0.55 END AS own FROM m)
SELECT contest_id, round(CASE WHEN winner_id IS NULL THEN 0.5 WHEN sign = 1 THEN greatest(0.55, own) ELSE 1 - greatest(0.55, own) END + 1e-9, 6) AS label,
       winner_id IS NOT NULL AND own < 0.55 - 1e-9 AS floored, coalesce(method = 'decision', false) AND rounds_a IS NULL AS estimated FROM w""")
def q_graded_label(spark, sf):
    """How clearly the first side won: by the time of a finish, or by rounds and judges on the cards, with the usual margin where there are none."""
    even = lambda x: F.when(x > 0, 1.0).when(x == 0, 0.5).otherwise(0.0)
    d = F.col("a") - F.col("b")
    per = cards(spark, sf).groupBy("contest_id", "judge").agg(F.sum(even(d)).alias("won"), F.sum(d).alias("total"), F.count("*").alias("n"))
    read = per.groupBy("contest_id").agg((F.sum("won") / F.sum("n")).alias("rounds_a"), F.avg(even(F.col("total"))).alias("judges_a"))
    c = by_contest(spark, sf, "a_id", "winner_id", "method", "round", "seconds", "scheduled").join(read, "contest_id", "left").withColumn("sign", F.when(F.col("winner_id") == F.col("a_id"), 1).otherwise(-1))
    usual = c.where("winner_id is not null and method = 'decision'").agg(F.avg(F.abs(2 * F.col("rounds_a") - 1)).alias("usual"))
    m = c.crossJoin(F.broadcast(usual))
    own = S.graded(F.col("method"), S.elapsed_seconds(F.col("round"), F.col("seconds"), F.col("scheduled")) / (F.col("scheduled") * 300), F.coalesce((2 * F.col("rounds_a") - 1) * F.col("sign"), F.col("usual")), F.abs(2 * F.coalesce("judges_a", F.lit(1.0)) - 1))
    won = F.greatest(F.lit(S.LEAST_WIN), own)
    label = F.when(F.col("winner_id").isNull(), 0.5).when(F.col("sign") == 1, won).otherwise(1 - won)
    estimated = F.coalesce(F.col("method") == "decision", F.lit(False)) & F.col("rounds_a").isNull()
    return m.select("contest_id", F.round(label + 1e-9, 6).alias("label"), (F.col("winner_id").isNotNull() & (own < S.LEAST_WIN - 1e-9)).alias("floored"), estimated.alias("estimated"))


@query(CASE + """
, e AS (SELECT contest_id, method, (round - 1) * 300 + seconds AS fin FROM f), b AS (SELECT *, unnest(range(0, fin + 1, 60)) AS start FROM e)
SELECT CAST(start // 300 + 1 AS INTEGER) AS round, count(*) AS bins, CAST(sum(least(60, fin - start)) AS BIGINT) AS exposure, count(*) FILTER (fin < start + 60 AND method = 'ko') AS ko, count(*) FILTER (fin < start + 60 AND method = 'submission') AS submission FROM b GROUP BY 1""")
def q_person_period(spark, sf):
    """Bins of a minute with the time at risk and what ended in them."""
    e = forecasts(spark, sf).select("method", ((F.col("round") - 1) * 300 + F.col("seconds")).alias("fin"))
    b = e.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("fin"), F.lit(60))))
    ends = lambda m: F.count(F.when((F.col("fin") < F.col("start") + 60) & (F.col("method") == m), 1)).alias(m)
    return b.groupBy((F.floor(F.col("start") / 300) + 1).cast("int").alias("round")).agg(F.count("*").alias("bins"), F.sum(F.least(F.lit(60), F.col("fin") - F.col("start"))).cast("long").alias("exposure"), ends("ko"), ends("submission"))


@query(CASE + """
, e AS (SELECT division, round, count(*) AS ended, count(*) FILTER (method = 'ko') AS ko, count(*) FILTER (method = 'submission') AS sub FROM f GROUP BY ALL),
r AS (SELECT *, sum(ended) OVER (PARTITION BY division ORDER BY round DESC) AS at_risk FROM e),
h AS (SELECT *, exp(coalesce(sum(CASE WHEN at_risk > ko + sub THEN ln(1 - (ko + sub) / at_risk) ELSE -30 END) OVER (PARTITION BY division ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS alive FROM r)
SELECT division, round, CAST(at_risk AS BIGINT) AS at_risk, round(alive, 6) AS alive, round(alive * ko / at_risk, 6) AS p_ko, round(alive * sub / at_risk, 6) AS p_submission FROM h""")
def q_competing_risks(spark, sf):
    """Exact chances of each way to end in each round: the hazards of two causes over those still going."""
    from pyspark.sql import Window

    n = lambda m: F.count(F.when(F.col("method") == m, 1))
    e = forecasts(spark, sf).groupBy("division", "round").agg(F.count("*").alias("ended"), n("ko").alias("ko"), n("submission").alias("sub"))
    r = e.withColumn("at_risk", F.sum("ended").over(Window.partitionBy("division").orderBy(F.desc("round"))))
    both = F.col("ko") + F.col("sub")
    stay = F.when(F.col("at_risk") > both, F.log(1 - both / F.col("at_risk"))).otherwise(-30.0)
    h = r.withColumn("alive", F.exp(F.coalesce(F.sum(stay).over(H.before("division", "round")), F.lit(0.0))))
    p = lambda c: F.round(F.col("alive") * F.col(c) / F.col("at_risk"), 6)
    return h.select("division", "round", "at_risk", F.round("alive", 6).alias("alive"), p("ko").alias("p_ko"), p("sub").alias("p_submission"))


#: One row a contest with what both sides had before it.
PRE = CONTEST + """, pre AS (
  SELECT contest_id, side, count(*) OVER w AS bouts, coalesce(avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END) OVER w, 0.5) AS rate, coalesce(day - max(day) OVER w, 365) AS layoff
  FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wide AS (
  SELECT c.contest_id, a.bouts AS bouts_a, b.bouts AS bouts_b, a.rate AS rate_a, b.rate AS rate_b, CAST(a.layoff AS BIGINT) AS layoff_a, CAST(b.layoff AS BIGINT) AS layoff_b, (c.contest_id * 7919 % 1000 + 0.5) / 1000 AS p
  FROM contest c JOIN pre a ON a.contest_id = c.contest_id AND a.side = 'a' JOIN pre b ON b.contest_id = c.contest_id AND b.side = 'b')"""


def wide(spark, sf):
    w = H.before("entity", "day", "contest_id")
    won = F.when(F.col("result") == "W", 1.0).otherwise(0.0)
    pre = perspectives(spark, sf).select("contest_id", "side", F.count("*").over(w).alias("bouts"), F.coalesce(F.avg(won).over(w), F.lit(0.5)).alias("rate"), F.coalesce(F.datediff("day", F.max("day").over(w)), F.lit(365)).cast("long").alias("layoff"))
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    both = pre.groupBy("contest_id").agg(*[of(c, s) for c in ("bouts", "rate", "layoff") for s in "ab"])
    return both.withColumn("p", (F.col("contest_id") * 7919 % 1000 + 0.5) / 1000)


@query(PRE + """
SELECT contest_id, bouts_a - bouts_b AS diff_bouts, round(rate_a - rate_b, 6) AS diff_rate, layoff_a - layoff_b AS diff_layoff, CAST(least(bouts_a, bouts_b) = 0 AS INTEGER) AS is_debut, round((layoff_a - layoff_b) * (rate_a + rate_b), 4) AS inter FROM wide""")
def q_feature_matrix(spark, sf):
    f = wide(spark, sf)
    gap = F.round((F.col("layoff_a") - F.col("layoff_b")) * (F.col("rate_a") + F.col("rate_b")), 4)
    out = f.select("contest_id", *differences(f, ["bouts", "rate", "layoff"]), (F.least("bouts_a", "bouts_b") == 0).cast("int").alias("is_debut"), gap.alias("inter"))
    return out.withColumn("diff_rate", F.round("diff_rate", 6))


@query(PRE + "SELECT contest_id, bouts_b AS bouts_a, bouts_a AS bouts_b, round(1 - p, 6) AS p FROM wide")
def q_swapped(spark, sf):
    return swapped(wide(spark, sf).select("contest_id", "bouts_a", "bouts_b", "p"), complements=("p",)).select("contest_id", "bouts_a", "bouts_b", F.round("p", 6).alias("p"))


@query(PRE + """
, x AS (SELECT *, CAST('0x' || left(md5(CAST(contest_id AS VARCHAR)), 1) AS INTEGER) % 2 = 1 AS flip FROM wide)
SELECT contest_id, CASE WHEN flip THEN bouts_b ELSE bouts_a END AS bouts_a, CASE WHEN flip THEN bouts_a ELSE bouts_b END AS bouts_b, round(CASE WHEN flip THEN 1 - p ELSE p END, 6) AS p FROM x""")
def q_symmetrise(spark, sf):
    """Sides exchanged for the half of contests that a hash of the key picks."""
    d = symmetrised(wide(spark, sf).select("contest_id", "bouts_a", "bouts_b", "p"), "contest_id", complements=("p",))
    return d.select("contest_id", "bouts_a", "bouts_b", F.round("p", 6).alias("p"))


MODEL = "1 / (1 + exp(-(0.8 * ({a} - {b}) + 0.1)))"


@query(PRE + f"SELECT contest_id, round(({MODEL.format(a='rate_a', b='rate_b')} + 1 - {MODEL.format(a='rate_b', b='rate_a')}) / 2, 6) AS p FROM wide")
def q_swap_average(spark, sf):
    """A model judged in both orders, and the mean of what it says."""
    model = lambda a, b: S.sigmoid(0.8 * (F.col(a) - F.col(b)) + 0.1)
    return wide(spark, sf).select("contest_id", F.round((model("rate_a", "rate_b") + 1 - model("rate_b", "rate_a")) / 2, 6).alias("p"))


@query(CASE + """
, g AS (SELECT t, 1 / (1 + exp(-ln(p / (1 - p)) / t)) AS p, y FROM f, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 4.0])::DOUBLE AS t)), s AS (SELECT t, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM g GROUP BY t)
SELECT arg_min(t, loss) AS t, round(min(loss), 6) AS loss FROM s""")
def q_grid_search(spark, sf):
    g = forecasts(spark, sf).withColumn("t", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0, 4.0)))))
    q = S.sigmoid(S.logit(F.col("p")) / F.col("t"))
    s = g.groupBy("t").agg(F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("loss"))
    return s.agg(F.min_by("t", "loss").alias("t"), F.round(F.min("loss"), 6).alias("loss"))


@query(CASE + """
SELECT contest_id, round(p_t, 6) AS tempered, CASE WHEN abs(p - 0.5) >= 0.18 THEN 'high' WHEN abs(p - 0.5) >= 0.08 THEN 'medium' ELSE 'low' END AS band, round(0.5 ** ((DATE '2001-08-01' - day) / 365.0), 6) AS weight
FROM (SELECT *, 1 / (1 + exp(-ln(p / (1 - p)) / 1.3)) AS p_t FROM f)""")
def q_calibrators(spark, sf):
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.col("day"))
    return forecasts(spark, sf).select("contest_id", F.round(S.temperature(F.col("p"), 1.3), 6).alias("tempered"), S.confidence_band(F.col("p")).alias("band"), F.round(S.recency_weight(age, 365.0), 6).alias("weight"))


@query(PRE + """
, d AS (SELECT rate_a - rate_b AS x, CAST(winner_id = a_id AS DOUBLE) AS y FROM wide JOIN contest USING (contest_id) WHERE winner_id IS NOT NULL)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, regr_count(y, x)::BIGINT AS n FROM d""")
def q_least_squares(spark, sf):
    d = wide(spark, sf).join(forecasts(spark, sf).select("contest_id", "y"), "contest_id").select((F.col("rate_a") - F.col("rate_b")).alias("x"), F.col("y").cast("double").alias("y"))
    r = lambda f, a: F.round(f("y", "x"), 6).alias(a)
    return d.agg(r(F.regr_slope, "slope"), r(F.regr_intercept, "intercept"), r(F.regr_r2, "r2"), F.regr_count("y", "x").alias("n"))


@query()
def q_ridge_fit(spark, sf):
    f = wide(spark, sf).join(forecasts(spark, sf).select("contest_id", "y"), "contest_id")
    d = f.select("y", (F.col("rate_a") - F.col("rate_b")).alias("rate"), ((F.col("bouts_a") - F.col("bouts_b")) / 10).alias("bouts"))
    got = E.ridge(d, "y", ["rate", "bouts"], 1.0)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "feature string, weight double")


@query()
def q_bootstrap_ci(spark, sf):
    d = forecasts(spark, sf).withColumn("loss", E.log_loss(F.col("p"), F.col("y")))
    return E.bootstrap(d, "day", "loss", 200)


@query()
def q_permutation_p(spark, sf):
    d = forecasts(spark, sf).select("contest_id", "division", "p", F.col("y").cast("double").alias("y"))
    return E.permutation(d, "contest_id", "division", "p", "y", 200)


@query()
def q_isotonic(spark, sf):
    d = forecasts(spark, sf).select("p", F.col("y").cast("double").alias("y"))
    return E.isotonic(d, "p", "y")
