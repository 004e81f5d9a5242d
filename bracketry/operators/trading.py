"""Orders in a market maker's markets, executed in their order.

A market maker of logarithmic scores takes what is spent whatever the prices, so that balances and prices are two folds: first
each trader's orders against the balance, then each market's accepted orders against its prices. An order of c coins scales all
prices by exp(-c / b) and gives the rest to its outcome: an affine map. A market's rows are therefore cut into stretches that
are scanned at once; the maps of whole stretches, a row each, tell what prices a stretch begins with. A market may hold any share
of all orders. A trader's orders stream through one task each, whose state is a balance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold
from .graph import stored

#: What may be spent at a time.
LEAST, MOST = 1, 1_000_000


def _log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), of which one may be minus infinity."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def log_prices(shares: Column, b: Column) -> Column:
    top = F.array_max(shares)
    total = F.log(F.aggregate(shares, F.lit(0.0), lambda s, q: s + F.exp((q - top) / b)))
    return F.transform(shares, lambda q: (q - top) / b - total)


def _checked(trades: DataFrame, markets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Orders with what they spend, and what speaks against them before (_early) and after (_late) a look at the balance."""
    m = markets.select("market_id", F.col("status").alias("_status"), F.col("closes_at").alias("_closes"), F.col("b").cast("double").alias("_b"), F.col("shares").cast("array<double>").alias("_shares"), F.lit(True).alias("_known"))
    a = accounts.select("user_id", F.floor("balance").cast("long").alias("_balance"))
    t = trades.join(m, "market_id", "left").join(a, "user_id", "left")
    coins = F.col("coins").cast("double")
    fits = F.coalesce(~F.isnan(coins) & (coins >= LEAST) & (coins <= MOST), F.lit(False))
    early = F.when(~fits, "INVALID_AMOUNT").when(F.col("_balance").isNull(), "PROFILE_NOT_FOUND")
    closed = (F.col("_status") != "open") | F.coalesce(F.col("_closes") <= F.col("at"), F.lit(False))
    n = F.coalesce(F.size("_shares"), F.lit(0))
    there = F.coalesce((F.col("outcome") >= 0) & (F.col("outcome") < n), F.lit(False))
    late = F.when(F.col("_known").isNull(), "MARKET_NOT_FOUND").when(F.coalesce(closed, F.lit(True)), "MARKET_CLOSED").when(n <= 0, "NO_OUTCOMES").when(~there, "OUTCOME_NOT_FOUND")
    return t.withColumns({"spent": F.when(fits, F.floor(coins)).cast("long"), "_early": early, "_late": late})


def _debit(balance: int, row: tuple) -> tuple[int, tuple]:
    spent, late, _ = row
    if balance < spent:
        return balance, ("NOT_ENOUGH_COINS", balance)
    if late:
        return balance, (late, balance)
    return balance - spent, (None, balance - spent)


def _scan(state: tuple[float, list[float]], row: tuple) -> tuple[tuple[float, list[float]], tuple]:
    """The map of a stretch so far: exponent and, for each outcome, the log of what was added."""
    total, added = state
    outcome, spent, b, shares = row
    added = added or [-math.inf] * len(shares)
    c = spent / b
    new = [x - c for x in added]
    gained = math.log(-math.expm1(-c))
    top, low = max(new[outcome], gained), min(new[outcome], gained)
    new[outcome] = top + math.log1p(math.exp(low - top))
    return (total + c, new), (total, added[outcome], total + c, new)


def execute(trades: DataFrame, markets: DataFrame, accounts: DataFrame) -> DataFrame:
    """trades with code (null if accepted), spent, balance_after, new_trader, shares_bought and price.

    trades: trade_id, at, user_id, market_id, outcome (place in shares), coins, in the order of at and trade_id; markets:
    market_id, status, closes_at, b, shares; accounts: user_id, balance, each with a row a key. Codes, the first that holds:
    INVALID_AMOUNT, PROFILE_NOT_FOUND, NOT_ENOUGH_COINS, MARKET_NOT_FOUND, MARKET_CLOSED, NO_OUTCOMES, OUTCOME_NOT_FOUND. A
    null amount, user or market is one that doesn't fit or isn't there. What is bought, and its price after that, are null for
    orders that were not accepted; their balance is as before, or null where it was not looked at (the first two codes). Other columns of trades come out as they are, but not those
    that are added.
    """
    own = [c for c in trades.columns if c not in ("code", "spent", "balance_after", "new_trader", "shares_bought", "price")]
    rows = _checked(trades.select(*own), markets, accounts)
    aside = rows.where(F.col("_early").isNotNull()).withColumns({"code": F.col("_early"), "balance_after": F.lit(None).cast("long")})
    live = rows.where(F.col("_early").isNull())
    told = ordered_fold(live, ["user_id"], ["at", "trade_id"], ["spent", "_late", "_balance"], lambda r: r[2], _debit, "code string, balance_after long")
    first = Window.partitionBy("user_id", "market_id").orderBy("at", "trade_id")
    told = stored(told.withColumn("new_trader", F.col("code").isNull() & (F.row_number().over(first.partitionBy("user_id", "market_id", F.col("code").isNull())) == 1)))
    none = lambda df: df.withColumns({"shares_bought": F.lit(None).cast("double"), "price": F.lit(None).cast("double")})
    bought = _priced(told.where("code is null"))
    out = bought.unionByName(none(told.where("code is not null")), allowMissingColumns=True).unionByName(none(aside.withColumn("new_trader", F.lit(False))), allowMissingColumns=True)
    return out.select(*own, "code", "spent", "balance_after", "new_trader", "shares_bought", "price")


def _priced(accepted: DataFrame) -> DataFrame:
    order = ["market_id", "at", "trade_id"]
    dealt = accepted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    adds = "_before double, _had double, _after double, _added array<double>"
    scanned = stored(ordered_fold(dealt, ["market_id"], [], ["outcome", "spent", "_b", "_shares"], lambda r: (0.0, []), _scan, adds, dealt=True))
    whole = F.max_by(F.struct("_after", "_added"), F.struct("at", "trade_id")).alias("m")
    maps = scanned.groupBy("market_id", "_part").agg(whole, F.first("_b").alias("b"), F.first("_shares").alias("shares"))
    # as many stretches of a market as partitions at most
    by = maps.groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct("_part", "m"))).alias("stretches"), F.first("b").alias("b"), F.first("shares").alias("shares"))
    empty = F.array().cast("array<struct<_part: int, start: array<double>>>")

    def after(s: Column, x: Column) -> Column:
        now = F.zip_with(s["now"], x["m"]["_added"], lambda p, a: _log_add(p - x["m"]["_after"], a))
        return F.struct(now.alias("now"), F.concat(s["out"], F.array(F.struct(x["_part"].alias("_part"), s["now"].alias("start")))).alias("out"))

    begun = F.aggregate("stretches", F.struct(log_prices(F.col("shares"), F.col("b")).alias("now"), empty.alias("out")), after, lambda s: s["out"])
    starts = by.select("market_id", F.inline(begun))
    met = scanned.join(starts, ["market_id", "_part"])
    begin = F.get("start", F.col("outcome"))
    was = _log_add(begin - F.col("_before"), F.col("_had"))
    now = _log_add(begin - F.col("_after"), F.get("_added", F.col("outcome")))
    return met.withColumns({"shares_bought": F.col("spent") + F.col("_b") * (now - was), "price": F.exp(now)})


def market_state(executed: DataFrame, markets: DataFrame) -> DataFrame:
    """(market_id, outcome, shares, price, volume, traders) after all accepted orders; markets without any stay as they were."""
    done = executed.where("code is null")
    sums = done.groupBy("market_id", "outcome").agg(F.sum("shares_bought").alias("bought"))
    bought = sums.groupBy("market_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("outcome").cast("int"), "bought"))).alias("by"))
    totals = done.groupBy("market_id").agg(F.sum("spent").alias("volume"), F.count_if("new_trader").alias("traders"))
    m = markets.select("market_id", F.col("b").cast("double").alias("b"), F.col("shares").cast("array<double>").alias("shares")).join(bought, "market_id", "left").join(totals, "market_id", "left")
    held = F.transform("shares", lambda q, i: q + F.coalesce(F.element_at("by", i), F.lit(0.0)))
    m = m.withColumn("held", held)
    priced = m.withColumn("prices", F.transform(log_prices(F.col("held"), F.col("b")), lambda x: F.exp(x)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return priced.select("market_id", F.posexplode(F.arrays_zip(F.col("held").alias("shares"), F.col("prices").alias("price"))).alias("outcome", "x"), zero("volume"), zero("traders")).select("market_id", "outcome", "x.shares", "x.price", "volume", "traders")


def refund(executed: DataFrame, market_ids: DataFrame, accounts: DataFrame, markets: DataFrame) -> DataFrame:
    """(trade_id, user_id, market_id, amount, balance_after): accepted orders of markets that are called off, paid back in order.

    market_ids has a column market_id. A market that is resolved or cancelled already pays nothing again. balance_after
    starts with the trader's balance after the last order, or the account's where there is none.
    """
    open_ = market_ids.select("market_id").distinct().join(markets.where("status not in ('resolved', 'cancelled')").select("market_id"), "market_id")
    last = executed.where("user_id is not null and balance_after is not null").groupBy("user_id").agg(F.max_by("balance_after", F.struct("at", "trade_id")).alias("_now"))
    due = executed.where("code is null").join(open_, "market_id", "left_semi").select("trade_id", "at", "user_id", "market_id", "spent")
    met = due.join(last, "user_id", "left").join(accounts.select("user_id", F.col("balance").alias("_first")), "user_id", "left")
    paid = Window.partitionBy("user_id").orderBy("at", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return met.select("trade_id", "user_id", "market_id", F.col("spent").alias("amount"), (F.coalesce("_now", "_first") + F.sum("spent").over(paid)).cast("long").alias("balance_after"))
