"""Queries of orders in their order: `events` as orders, one market with two fifths of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trading
from .base import table
from .registry import query

BALANCE, B = 1000, 100.0


def orders(spark, sf):
    k = F.col("event_id")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    market = F.when(k % 97 == 0, 9).otherwise(kind)
    return table(spark, sf, "events").select(k.alias("trade_id"), F.col("ts").alias("at"), "user_id", market.alias("market_id"), (k % 4).cast("int").alias("outcome"), F.col("value").alias("coins"))


def markets(spark, sf):
    """Those of known orders: 1 closes early, 3 is resolved, and each has three outcomes."""
    m = orders(spark, sf).where("market_id < 9").select("market_id").distinct()
    closes = F.when(F.col("market_id") == 1, F.lit("2024-01-20").cast("timestamp"))
    status = F.when(F.col("market_id") == 3, "resolved").otherwise("open")
    q = F.col("market_id").cast("double")
    return m.select("market_id", status.alias("status"), closes.alias("closes_at"), F.lit(B).alias("b"), F.array(F.lit(0.0), 10 * q, F.lit(40.0)).alias("shares"))


def accounts(spark, sf):
    return orders(spark, sf).where("user_id % 10 <> 0").select("user_id").distinct().withColumn("balance", F.lit(BALANCE).cast("long"))


#: Two plain recursions: a step is the next order of every trader, then of every market.
TRADES = f"""
WITH RECURSIVE orders AS (
  SELECT event_id AS trade_id, ts AS at_, user_id, event_id % 4 AS outcome, value AS coins,
         CASE WHEN event_id % 97 = 0 THEN 9 WHEN event_type IN ('purchase', 'signup') THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS market_id FROM events
), checked AS (
  SELECT *, CAST(CASE WHEN coins >= 1 AND coins <= 1000000 THEN floor(coins) END AS BIGINT) AS spent,
         CASE WHEN coins IS NULL OR NOT (coins >= 1 AND coins <= 1000000) THEN 'INVALID_AMOUNT' WHEN user_id IS NULL OR user_id % 10 = 0 THEN 'PROFILE_NOT_FOUND' END AS early,
         CASE WHEN market_id = 9 THEN 'MARKET_NOT_FOUND' WHEN market_id = 3 OR (market_id = 1 AND at_ >= TIMESTAMP '2024-01-20') THEN 'MARKET_CLOSED' WHEN outcome > 2 THEN 'OUTCOME_NOT_FOUND' END AS late
  FROM orders
), queue AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_, trade_id) AS k FROM checked WHERE early IS NULL
), debit AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS trade_id, {BALANCE}::BIGINT AS balance, NULL::VARCHAR AS code FROM (SELECT DISTINCT user_id FROM queue)
  UNION ALL
  SELECT q.user_id, q.k, q.trade_id, CASE WHEN balance < spent OR late IS NOT NULL THEN balance ELSE balance - spent END, CASE WHEN balance < spent THEN 'NOT_ENOUGH_COINS' ELSE late END
  FROM debit d JOIN queue q ON q.user_id = d.user_id AND q.k = d.k + 1
), told AS (
  SELECT c.*, coalesce(early, d.code) AS code, d.balance AS balance_after FROM checked c LEFT JOIN debit d ON d.trade_id = c.trade_id
), accepted AS (
  SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY at_, trade_id) AS k, row_number() OVER (PARTITION BY user_id, market_id ORDER BY at_, trade_id) = 1 AS new_trader FROM told WHERE code IS NULL
), path AS (
  SELECT market_id, 0::BIGINT AS k, NULL::BIGINT AS trade_id, [exp(0.0), exp(10.0 * market_id / {B}), exp(40.0 / {B})] AS w, NULL::DOUBLE AS shares_bought, NULL::DOUBLE AS price
  FROM (SELECT DISTINCT market_id FROM accepted)
  UNION ALL
  SELECT market_id, k, trade_id, [x / list_sum(new) FOR x IN new], {B} * ln(new[outcome + 1] / w[outcome + 1]), new[outcome + 1] / list_sum(new) FROM (
    SELECT a.market_id, a.k, a.trade_id, a.outcome, w, [CASE WHEN i = a.outcome + 1 THEN x + list_sum(w) * (exp(spent / {B}) - 1) ELSE x END FOR x, i IN w] AS new
    FROM path p JOIN accepted a ON a.market_id = p.market_id AND a.k = p.k + 1)
), executed AS (
  SELECT t.trade_id, t.user_id, t.market_id, CAST(t.outcome AS INTEGER) AS outcome, t.at_, t.code, t.spent, t.balance_after, coalesce(a.new_trader, false) AS new_trader, p.shares_bought, p.price
  FROM told t LEFT JOIN accepted a ON a.trade_id = t.trade_id LEFT JOIN path p ON p.trade_id = t.trade_id
)"""


@query(f"{TRADES} SELECT trade_id, code, spent, balance_after, new_trader, round(shares_bought, 6) AS shares_bought, round(price, 8) AS price FROM executed")
def q_trades(spark, sf):
    """Every order with its price, or why it was turned down."""
    e = trading.execute(orders(spark, sf), markets(spark, sf), accounts(spark, sf))
    return e.select("trade_id", "code", "spent", "balance_after", "new_trader", F.round("shares_bought", 6).alias("shares_bought"), F.round("price", 8).alias("price"))


@query(f"""{TRADES}, q AS (
  SELECT market_id, [0.0, 10.0 * market_id, 40.0] AS q FROM (SELECT DISTINCT market_id FROM orders WHERE market_id < 9)
), held AS (
  SELECT market_id, i - 1 AS outcome, q[i] + coalesce((SELECT sum(shares_bought) FROM executed e WHERE e.market_id = q.market_id AND e.outcome = i - 1), 0) AS shares FROM q, (SELECT unnest([1, 2, 3]) AS i)
), total AS (
  SELECT market_id, CAST(sum(spent) AS BIGINT) AS volume, count(*) FILTER (new_trader) AS traders FROM executed WHERE code IS NULL GROUP BY market_id
)
SELECT market_id, CAST(outcome AS INTEGER) AS outcome, round(shares, 4) AS shares, round(exp((shares - max(shares) OVER w) / {B}) / sum(exp((shares - m) / {B})) OVER w, 8) AS price,
       coalesce(volume, 0) AS volume, coalesce(traders, 0) AS traders
FROM (SELECT *, max(shares) OVER (PARTITION BY market_id) AS m FROM held) LEFT JOIN total USING (market_id) WINDOW w AS (PARTITION BY market_id)""")
def q_market_state(spark, sf):
    """Shares and prices that all orders leave behind, what was spent and by how many."""
    m = markets(spark, sf)
    s = trading.market_state(trading.execute(orders(spark, sf), m, accounts(spark, sf)), m)
    return s.select("market_id", "outcome", F.round("shares", 4).alias("shares"), F.round("price", 8).alias("price"), "volume", "traders")


@query(f"""{TRADES}, last AS (
  SELECT user_id, arg_max(balance_after, (at_, trade_id)) AS now FROM (SELECT * FROM executed WHERE balance_after IS NOT NULL) GROUP BY user_id)
SELECT trade_id, user_id, spent AS amount, CAST(now + sum(spent) OVER (PARTITION BY user_id ORDER BY at_, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after
FROM executed JOIN last USING (user_id) WHERE code IS NULL AND market_id = 2""")
def q_market_refund(spark, sf):
    """Market 2 called off, and 3, which is resolved and pays nothing."""
    o, m, a = orders(spark, sf), markets(spark, sf), accounts(spark, sf)
    off = m.where("market_id in (2, 3)").select("market_id")
    r = trading.refund(trading.execute(o, m, a), off, a, m)
    return r.select("trade_id", "user_id", "amount", "balance_after")
