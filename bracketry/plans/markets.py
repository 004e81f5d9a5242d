"""Prices, boards, settlement and market making."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import scalar as S
from ..operators import history as H
from .base import CONTEST, contests, table
from .registry import query

#: Two prices a contest, American at first, and a model's probability, by rules over its key.
QUOTE = CONTEST + """, american AS (
  SELECT *, CASE WHEN contest_id % 11 = 0 THEN 50 WHEN contest_id % 2 = 0 THEN 100 + contest_id % 300 ELSE -100 - contest_id % 400 END AS va,
         CASE WHEN contest_id % 3 = 0 THEN 100 + contest_id * 7 % 250 ELSE -100 - contest_id * 7 % 350 END AS vb, (contest_id * 7919 % 1000 + 0.5) / 1000 AS model FROM contest
), quote AS (
  SELECT *, CASE WHEN va >= 100 THEN round(1 + va / 100, 3) WHEN va <= -100 THEN round(1 + 100 / abs(va), 3) END AS a, CASE WHEN vb >= 100 THEN round(1 + vb / 100, 3) WHEN vb <= -100 THEN round(1 + 100 / abs(vb), 3) END AS b FROM american
), priced AS (SELECT *, CASE WHEN a > 1 AND b > 1 THEN (1 / a) / (1 / a + 1 / b) END AS market FROM quote)"""


def priced(spark, sf):
    k = F.col("contest_id")
    va = F.when(k % 11 == 0, 50).when(k % 2 == 0, 100 + k % 300).otherwise(-100 - k % 400)
    vb = F.when(k % 3 == 0, 100 + k * 7 % 250).otherwise(-100 - k * 7 % 350)
    q = contests(spark, sf).withColumns({"a": O.american_to_decimal(va), "b": O.american_to_decimal(vb), "model": (k * 7919 % 1000 + 0.5) / 1000})
    return q.withColumn("market", O.devig(F.col("a"), F.col("b")))


@query(QUOTE + "SELECT contest_id, a, b FROM quote")
def q_american_to_decimal(spark, sf):
    return priced(spark, sf).select("contest_id", "a", "b")


@query(QUOTE + "SELECT contest_id, round(market, 6) AS market FROM priced")
def q_devig(spark, sf):
    return priced(spark, sf).select("contest_id", F.round("market", 6).alias("market"))


GUARD = "greatest(1e-6, least(1 - 1e-6, CASE WHEN market IS NULL THEN model ELSE least(market + 0.15, greatest(market - 0.15, model)) END))"


@query(QUOTE + f"SELECT contest_id, round({GUARD}, 6) AS p FROM priced")
def q_edge_guard(spark, sf):
    return priced(spark, sf).select("contest_id", F.round(O.edge_guard(F.col("model"), F.col("market")), 6).alias("p"))


LINE = "least(25.0, greatest(1.02, round(1 / (greatest({0}, 1e-9) * 1.05), 2)))"


@query(QUOTE + f"SELECT contest_id, {LINE.format('p')} AS price_a, {LINE.format('(1 - p)')} AS price_b FROM (SELECT contest_id, {GUARD} AS p FROM priced)")
def q_margin_price(spark, sf):
    p = O.edge_guard(F.col("model"), F.col("market"))
    prices = priced(spark, sf).select("contest_id", O.margin_prices(F.array(p, 1 - p), 0.05).alias("x"))
    return prices.select("contest_id", F.get("x", 0).alias("price_a"), F.get("x", 1).alias("price_b"))


#: Shares of ways to win; every fifth contest has none.
WAYS = "CASE WHEN contest_id % 5 = 0 THEN [0.0, 0.0, 0.0] ELSE [contest_id % 7 + 1.0, contest_id % 3 + 1.0, contest_id % 4 + 0.5] END"


@query(QUOTE + f"""
, cells AS (SELECT contest_id, s.side, s.p, CAST({WAYS} AS DOUBLE[]) AS w FROM (SELECT contest_id, {GUARD} AS p FROM priced) g, LATERAL (SELECT 'a' AS side, g.p AS p UNION ALL SELECT 'b', 1 - g.p) s)
SELECT contest_id, side, m AS method, round(CASE WHEN list_sum(w) > 0 THEN w[i] / list_sum(w) * p ELSE p / 3 END + 1e-9, 6) AS probability
FROM cells, (SELECT 1 AS i, 'ko' AS m UNION ALL SELECT 2, 'submission' UNION ALL SELECT 3, 'decision')""")
def q_outcome_board(spark, sf):
    p, k = O.edge_guard(F.col("model"), F.col("market")), F.col("contest_id")
    zero = F.array(*[F.lit(0.0)] * 3)
    ways = F.when(k % 5 == 0, zero).otherwise(F.array((k % 7 + 1).cast("double"), (k % 3 + 1).cast("double"), (k % 4 + 0.5).cast("double")))
    two = priced(spark, sf).select("contest_id", ways.alias("w"), F.inline(F.array(F.struct(F.lit("a").alias("side"), p.alias("p")), F.struct(F.lit("b").alias("side"), (1 - p).alias("p")))))
    names = F.array(*map(F.lit, ("ko", "submission", "decision")))
    cells = two.select("contest_id", "side", F.inline(F.arrays_zip(names.alias("method"), O.reconcile(F.col("w"), F.col("p")).alias("q"))).alias("method", "q"))
    return cells.select("contest_id", "side", "method", F.round(F.col("q") + 1e-9, 6).alias("probability"))


#: A bet a contest: its selection, price and stake by rules over the key.
BET = QUOTE + """, bet AS (
  SELECT contest_id, (['a', 'b', 'finish', 'distance'])[contest_id % 4 + 1] AS code, contest_id % 90 + 10 AS stake, contest_id // 3 AS parlay, method, winner_id, a_id, round(1 + (contest_id % 40 + 1) / 20, 2) AS price,
         CASE WHEN winner_id IS NULL THEN NULL ELSE winner_id = a_id END AS won_a, coalesce(method IN ('ko', 'submission'), false) AS fin, method IS NOT NULL OR winner_id IS NOT NULL AS settled FROM priced
), graded AS (
  SELECT *, CASE WHEN NOT settled THEN 'open' WHEN code IN ('a', 'b') THEN CASE WHEN won_a IS NULL THEN 'void' WHEN won_a = (code = 'a') THEN 'won' ELSE 'lost' END
                 WHEN fin = (code = 'finish') THEN 'won' ELSE 'lost' END AS status FROM bet)"""


def graded(spark, sf):
    k = F.col("contest_id")
    won_a = F.when(F.col("winner_id").isNotNull(), F.col("winner_id") == F.col("a_id"))
    fin = F.coalesce(F.col("method").isin("ko", "submission"), F.lit(False))
    code = F.element_at(F.array(*map(F.lit, ("a", "b", "finish", "distance"))), (k % 4 + 1).cast("int"))
    settled = F.col("method").isNotNull() | F.col("winner_id").isNotNull()
    bets = contests(spark, sf).select(
        "contest_id", code.alias("code"), (k % 90 + 10).alias("stake"), F.floor(k / 3).alias("parlay"), F.round(1 + (k % 40 + 1) / 20, 2).alias("price"), O.grade(code, won_a, fin, settled).alias("status")
    )
    return bets


@query(BET + "SELECT contest_id, code, status FROM graded")
def q_grade_selections(spark, sf):
    return graded(spark, sf).select("contest_id", "code", "status")


@query(BET + """
SELECT parlay, count(*) AS legs, CASE WHEN bool_or(status = 'lost') THEN 0 WHEN bool_or(status = 'open') THEN NULL WHEN bool_and(status = 'void') THEN min(stake)
       ELSE CAST(floor(min(stake) * least(1000, round(exp(sum(CASE WHEN status = 'won' THEN ln(price) ELSE 0 END)) + 1e-9, 2)) + 1e-9) AS BIGINT) END AS payout FROM graded GROUP BY parlay""")
def q_parlay_resolve(spark, sf):
    """Any lost leg pays nothing, void legs drop out, all void gives the stake back."""
    s = F.col("status")
    combined = F.round(F.exp(F.sum(F.when(s == "won", F.log("price")).otherwise(0.0))) + 1e-9, 2)
    pays = F.floor(F.min("stake") * F.least(F.lit(1000.0), combined) + 1e-9).cast("long")
    out = F.when(F.bool_or(s == "lost"), F.lit(0).cast("long")).when(F.bool_or(s == "open"), F.lit(None)).when(F.bool_and(s == "void"), F.min("stake")).otherwise(pays)
    return graded(spark, sf).groupBy("parlay").agg(F.count("*").alias("legs"), out.alias("payout"))


@query(BET + """
SELECT margin, code, count(*) AS bets, count(*) FILTER (status = 'void') AS voids, CAST(sum(stake) AS BIGINT) AS staked, round(sum(CASE status WHEN 'lost' THEN stake WHEN 'won' THEN stake - stake * price / (1 + margin) ELSE 0 END), 4) AS pnl,
       round(sum(CASE status WHEN 'lost' THEN stake WHEN 'won' THEN stake - stake * price / (1 + margin) ELSE 0 END) / sum(stake), 6) AS hold
FROM graded, (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS margin) WHERE status <> 'open' GROUP BY ALL""")
def q_backtest_hold(spark, sf):
    """What the house keeps at each margin. The margins are a short list of scenarios."""
    g = graded(spark, sf).where("status <> 'open'").withColumn("margin", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.1)))))
    pnl = F.when(F.col("status") == "lost", F.col("stake").cast("double")).when(F.col("status") == "won", F.col("stake") - F.col("stake") * F.col("price") / (1 + F.col("margin"))).otherwise(0.0)
    return g.groupBy("margin", "code").agg(
        F.count("*").alias("bets"), F.count(F.when(F.col("status") == "void", 1)).alias("voids"), F.sum("stake").alias("staked"), F.round(F.sum(pnl), 4).alias("pnl"), F.round(F.sum(pnl) / F.sum("stake"), 6).alias("hold")
    )


@query("""
WITH q AS (SELECT user_id, list(CAST(n AS DOUBLE) ORDER BY event_type) AS q FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
SELECT user_id, round(list_max(q) + 20 * ln(list_sum(list_transform(q, lambda x: exp((x - list_max(q)) / 20)))), 6) AS cost, round(exp((q[1] - list_max(q)) / 20) / list_sum(list_transform(q, lambda x: exp((x - list_max(q)) / 20))), 6) AS first_price FROM q""")
def q_lmsr_prices(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    q = n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: x["n"]).alias("q"))
    return q.select("user_id", F.round(O.lmsr_cost(F.col("q"), 20.0), 6).alias("cost"), F.round(F.get(O.lmsr_prices(F.col("q"), 20.0), 0), 6).alias("first_price"))


@query(QUOTE + "SELECT contest_id, round(20 * ln((exp(stake / 20) - (1 - model)) / model), 6) AS shares, round(20 * ln(model), 6) AS seed FROM (SELECT contest_id, model, (contest_id % 50 + 1)::DOUBLE AS stake FROM priced)")
def q_lmsr_buy(spark, sf):
    spend = (F.col("contest_id") % 50 + 1).cast("double")
    return priced(spark, sf).select("contest_id", F.round(O.lmsr_shares_for(F.col("model"), spend, 20.0), 6).alias("shares"), F.round(O.lmsr_seed(F.col("model"), 20.0), 6).alias("seed"))


@query("SELECT user_id, event_type, round(median(value), 3) AS consensus, max(value) AS best, count(*) AS quotes FROM events WHERE value > 1 GROUP BY ALL")
def q_book_consensus(spark, sf):
    return table(spark, sf, "events").where("value > 1").groupBy("user_id", "event_type").agg(F.round(F.median("value"), 3).alias("consensus"), F.max("value").alias("best"), F.count("*").alias("quotes"))


@query("""
SELECT user_id, day, event_type, value FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id) AS k FROM events) WHERE k = 1""")
def q_closing_line(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return H.first_by(e, ["user_id", "day"], [(F.col("event_type") == "purchase").desc(), F.desc("ts"), F.col("event_id")]).select("user_id", "day", "event_type", "value")


@query("""
WITH q AS (SELECT user_id, event_type, first(value ORDER BY ts, event_id) AS opening, last(value ORDER BY ts, event_id) AS closing, count(*) AS n FROM events WHERE value > 1 GROUP BY ALL)
SELECT event_type, count(*) AS n, round(avg(opening / closing - 1), 6) AS clv, round(avg(CASE WHEN opening > closing THEN 1.0 ELSE 0.0 END), 6) AS beat FROM q WHERE n > 1 GROUP BY event_type""")
def q_closing_value(spark, sf):
    order = F.struct("ts", "event_id")
    q = table(spark, sf, "events").where("value > 1").groupBy("user_id", "event_type").agg(F.min_by("value", order).alias("opening"), F.max_by("value", order).alias("closing"), F.count("*").alias("n")).where("n > 1")
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("opening") / F.col("closing") - 1), 6).alias("clv"), F.round(F.avg(F.when(F.col("opening") > F.col("closing"), 1.0).otherwise(0.0)), 6).alias("beat"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'top' WHEN c_acctbal >= 6000 THEN 'high' WHEN c_acctbal >= 3000 THEN 'middle' ELSE 'low' END AS tier, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS shown FROM customer")
def q_tiers(spark, sf):
    b = F.col("c_acctbal")
    tier = S.banded(b, [(9000, "top"), (6000, "high"), (3000, "middle")], "low")
    return table(spark, sf, "customer").select("c_custkey", tier.alias("tier"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("shown"))


@query("SELECT user_id, day, claims, row_number() OVER (PARTITION BY user_id ORDER BY day) AS nth FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS claims FROM events WHERE event_type = 'login' OR event_type = 'click' GROUP BY ALL)")
def q_daily_claims(spark, sf):
    d = table(spark, sf, "events").where("event_type = 'login' or event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("claims"))
    return d.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long"))
