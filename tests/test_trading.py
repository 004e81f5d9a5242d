"""Orders against a plain replay, one after the other."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from bracketry.operators import trading
from bracketry.operators.folds import ordered_fold

TRADES = "trade_id long, at long, user_id string, market_id string, outcome int, coins double"
MARKETS = "market_id string, status string, closes_at long, b double, shares array<double>"
ACCOUNTS = "user_id string, balance long"


def cost(q, b):
    top = max(q)
    return top + b * math.log(sum(math.exp((x - top) / b) for x in q))


def bought(q, b, i, coins):
    """Shares by bisection on the cost."""
    lo, hi = 0.0, max(100.0, coins * 100)
    price = lambda s: cost([x + s * (k == i) for k, x in enumerate(q)], b) - cost(q, b)
    while price(hi) < coins:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if price(mid) > coins else (mid, hi)
    return lo


def plain(trades, markets, accounts):
    balance, held = {u: b for u, b in accounts}, {m[0]: list(m[4] or []) for m in markets}
    market, traders, out = {m[0]: m for m in markets}, set(), {}
    for tid, at, user, mid, outcome, coins in sorted(trades, key=lambda t: (t[1], t[0])):
        now, code, got = balance.get(user), None, (None, None)
        new = False
        if coins is None or not 1 <= coins <= 1_000_000:
            code = "INVALID_AMOUNT"
        elif now is None:
            code = "PROFILE_NOT_FOUND"
        elif now < math.floor(coins):
            code = "NOT_ENOUGH_COINS"
        elif mid not in market:
            code = "MARKET_NOT_FOUND"
        elif market[mid][1] != "open" or (market[mid][2] is not None and market[mid][2] <= at):
            code = "MARKET_CLOSED"
        elif not held[mid]:
            code = "NO_OUTCOMES"
        elif outcome is None or not 0 <= outcome < len(held[mid]):
            code = "OUTCOME_NOT_FOUND"
        else:
            b, q = market[mid][3], held[mid]
            s = bought(q, b, outcome, math.floor(coins))
            q[outcome] += s
            top = max(q)
            got = (s, math.exp((q[outcome] - top) / b) / sum(math.exp((x - top) / b) for x in q))
            balance[user] = now = now - math.floor(coins)
            new = (user, mid) not in traders
            traders.add((user, mid))
        out[tid] = (code, now, new, *got)
    return out, held, balance


def made(seed, n):
    rnd = random.Random(seed)
    markets = [("hot", "open", None, 100.0, [0.0, 0.0]), ("thin", "open", 60, 5.0, [3.0, 0.0, 1.0]), ("shut", "resolved", None, 9.0, [0.0, 0.0]), ("bare", "open", None, 9.0, None), (None, "open", None, 1.0, [0.0])]
    accounts = [(f"u{i}", rnd.randrange(200, 4000)) for i in range(12)]
    trades = []
    for i in range(n):
        user = rnd.choice(["u0", "u0", *[f"u{i}" for i in range(13)], None])
        coins = rnd.choice([None, 0.5, float("nan"), 2e6, *[rnd.uniform(1, 60)] * 12])
        trades.append((i, rnd.randrange(100), user, rnd.choice(["hot", "hot", "hot", "thin", "shut", "bare", "none", None]), rnd.choice([0, 0, 1, 1, 2, -1, None]), coins))
    return trades, markets, accounts


def near(a, b, tol):
    return a == b or (a is not None and b is not None and abs(a - b) <= tol * max(1, abs(b)))


def test_plain_replay(spark):
    """Most orders in one market and a third of one trader; ties in time, nulls, and columns of other names."""
    for seed, n in ((1, 900), (2, 40)):
        trades, markets, accounts = made(seed, n)
        t = spark.createDataFrame(trades, TRADES).withColumns({"code": F.lit(1), "b": F.lit(2), "status": F.lit(3), "_part": F.lit(4)}).repartition(3)
        m, a = spark.createDataFrame(markets, MARKETS), spark.createDataFrame(accounts, ACCOUNTS)
        e = trading.execute(t.drop("_part"), m, a)
        want, held, balance = plain(trades, [x for x in markets if x[0]], accounts)
        got = {r.trade_id: r for r in e.collect()}
        assert set(got) == set(want)
        for k, (code, now, new, s, p) in want.items():
            r = got[k]
            assert (r.code, r.new_trader) == (code, new) and r.balance_after == (None if code == "INVALID_AMOUNT" else now), (k, r, want[k])
            assert near(r.shares_bought, s, 1e-8) and near(r.price, p, 1e-9), (k, r, want[k])
        state = trading.market_state(e, m.where("market_id is not null")).collect()
        assert all(near(r.shares, held[r.market_id][r.outcome], 1e-8) for r in state) and len(state) == sum(map(len, held.values()))
        for mid in ("hot", "thin"):
            prices = [r.price for r in state if r.market_id == mid]
            assert abs(sum(prices) - 1) < 1e-9


def test_a_long_run_on_one_side(spark):
    """Prices far beyond what a double's exponent holds, over many stretches."""
    markets, accounts = [("m", "open", None, 1.0, [0.0, 0.0])], [("u", 10**9)]
    trades = [(i, i, "u", "m", 0 if i < 400 else 1, 50.0) for i in range(800)]
    e = trading.execute(spark.createDataFrame(trades, TRADES), spark.createDataFrame(markets, MARKETS), spark.createDataFrame(accounts, ACCOUNTS))
    r = {x.trade_id: x for x in e.collect()}
    assert abs(r[399].shares_bought - 50) < 1e-9 and r[399].price == 1.0
    # the other side's first shares have to make up for all that was spent
    assert abs(r[400].shares_bought - (50 + math.log(-math.expm1(-50)) + 400 * 50 + math.log(2))) < 1e-6
    assert sum(x.spent for x in r.values()) == 800 * 50 and r[799].balance_after == 10**9 - 800 * 50


def test_refunds(spark):
    trades, markets, accounts = made(3, 300)
    t, m, a = spark.createDataFrame(trades, TRADES), spark.createDataFrame(markets[:4], MARKETS), spark.createDataFrame(accounts, ACCOUNTS)
    e = trading.execute(t, m, a)
    want, _, balance = plain(trades, markets[:4], accounts)
    off = spark.createDataFrame([("hot",), ("hot",), ("shut",), ("none",)], "market_id string")
    back = trading.refund(e, off, a, m).collect()
    due = [x for x in trades if x[3] == "hot" and want[x[0]][0] is None]
    assert sorted(r.trade_id for r in back) == sorted(x[0] for x in due)
    for u, _b in accounts:
        own = [x for x in due if x[2] == u]
        if own:
            last = max(own, key=lambda x: (x[1], x[0]))[0]
            assert next(r.balance_after for r in back if r.trade_id == last) == balance[u] + sum(math.floor(x[5]) for x in own)


def test_no_orders(spark):
    t, m, a = spark.createDataFrame([], TRADES), spark.createDataFrame([], MARKETS), spark.createDataFrame([], ACCOUNTS)
    e = trading.execute(t, m, a)
    assert e.count() == 0 and trading.market_state(e, m).count() == 0 and trading.refund(e, m, a, m).count() == 0


def test_folds_carry_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = spark.range(100).selectExpr("if(id % 10 = 0, null, id % 3) k", "id", "cast(id as string) s")
        got = ordered_fold(d, ["k"], ["id"], ["id"], lambda r: 0, lambda s, r: (s + r[0], (s,)), "before long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r.before == sums.get(r.k, 0) and r.s == str(r.id)
        sums[r.k] = sums.get(r.k, 0) + r.id
    assert len(got) == 100
