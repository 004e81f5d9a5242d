"""Feature rows, forecasts against results and prices, bets in their context, and titles and links of pages."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import regression as R
from .base import CONTEST, contests, perspectives, table
from .markets import BET, graded
from .registry import query
from .trials import CASE, LOSS, forecasts


@query(CONTEST + "SELECT contest_id, CASE WHEN winner_id = b_id THEN b_id ELSE a_id END AS first, CASE WHEN winner_id = b_id THEN a_id ELSE b_id END AS second, coalesce(winner_id = b_id, false) AS turned FROM contest")
def q_winner_first(spark, sf):
    turned = F.coalesce(F.col("winner_id") == F.col("b_id"), F.lit(False))
    return contests(spark, sf).select("contest_id", F.when(turned, F.col("b_id")).otherwise(F.col("a_id")).alias("first"), F.when(turned, F.col("a_id")).otherwise(F.col("b_id")).alias("second"), turned.alias("turned"))


#: What a model was fitted on, in its order.
CONTRACT = ["contest_id", "is_light", "is_middle", "is_heavy", "is_other", "long", "late"]


@query(CONTEST + """
SELECT contest_id, CAST(division = 'light' AS INTEGER) AS is_light, CAST(division = 'middle' AS INTEGER) AS is_middle, CAST(division = 'heavy' AS INTEGER) AS is_heavy, CAST(division NOT IN ('light', 'middle', 'heavy') AS INTEGER) AS is_other,
       CAST(scheduled = 5 AS INTEGER) AS long, CAST(round >= scheduled AS INTEGER) AS late FROM contest""")
def q_one_hot(spark, sf):
    """Categories as columns, selected by the contract: a column that is missing is an error."""
    known = ("light", "middle", "heavy")
    one = {f"is_{v}": (F.col("division") == v).cast("int") for v in known}
    rest = {"is_other": (~F.col("division").isin(*known)).cast("int"), "long": (F.col("scheduled") == 5).cast("int"), "late": (F.col("round") >= F.col("scheduled")).cast("int")}
    made = contests(spark, sf).withColumns(one | rest)
    missing = [c for c in CONTRACT if c not in made.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return made.select(*CONTRACT)


@query(CONTEST + """
, b AS (SELECT o_custkey AS entity, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT contest_id, CAST(coalesce(x.n, 20) - coalesce(y.n, 20) AS BIGINT) AS d_n, round(coalesce(x.top, 1000) - coalesce(y.top, 1000), 4) AS d_top, CAST(x.n IS NULL AS INTEGER) + CAST(y.n IS NULL AS INTEGER) AS unknown, CAST(x.n IS NOT NULL AND y.n IS NOT NULL AS INTEGER) AS both_known
FROM contest LEFT JOIN b x ON x.entity = a_id LEFT JOIN b y ON y.entity = b_id""")
def q_pair_block(spark, sf):
    """Differences that turn with the sides, filled where one is unknown, and flags that don't turn."""
    b = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    x, y = (b.select(F.col("k").alias(f"{s}_id"), F.col("n").alias(f"n_{s}"), F.col("top").alias(f"top_{s}")) for s in ("a", "b"))
    d = contests(spark, sf).select("contest_id", "a_id", "b_id").join(x, "a_id", "left").join(y, "b_id", "left")
    diff = lambda c, fill: F.coalesce(f"{c}_a", F.lit(fill)) - F.coalesce(f"{c}_b", F.lit(fill))
    none = F.col("n_a").isNull().cast("int") + F.col("n_b").isNull().cast("int")
    return d.select("contest_id", diff("n", 20).cast("long").alias("d_n"), F.round(diff("top", 1000.0), 4).alias("d_top"), none.alias("unknown"), (none == 0).cast("int").alias("both_known"))


#: Forecasts with a price of side a and a forecast of the way: six cells a contest.
PRICED = CASE + """, w AS (SELECT *, round(1 + (contest_id * 31 % 300) / 100.0, 2)::DOUBLE AS price FROM f)"""


def priced(spark, sf):
    return forecasts(spark, sf).withColumn("price", F.round(1 + (F.col("contest_id") * 31 % 300) / 100, 2))


@query(PRICED + """
, t AS (SELECT unnest([0.0, 0.05, 0.1, 0.2])::DOUBLE AS least)
SELECT coalesce(method, 'none') AS method, least, count(*) AS bets, round(avg(CASE WHEN y = 1 THEN price - 1 ELSE -1 END), 6) AS roi, round(avg(p * price - 1), 6) AS expected FROM w, t WHERE p * price - 1 >= least GROUP BY ALL""")
def q_roi_thresholds(spark, sf):
    """Return by the least expected value that a bet needs. A bet is listed under every threshold that it meets."""
    ev = F.col("p") * F.col("price") - 1
    met = F.filter(F.array(*map(F.lit, (0.0, 0.05, 0.1, 0.2))), lambda t: ev >= t)
    d = priced(spark, sf).select(F.coalesce("method", F.lit("none")).alias("method"), ev.alias("ev"), F.when(F.col("y") == 1, F.col("price") - 1).otherwise(-1.0).alias("gain"), F.explode(met).alias("least"))
    return d.groupBy("method", "least").agg(F.count("*").alias("bets"), F.round(F.avg("gain"), 6).alias("roi"), F.round(F.avg("ev"), 6).alias("expected"))


@query(CASE + """
, x AS (SELECT division, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS hit, (p - y) * (p - y) AS b FROM f)
SELECT division, count(*) AS n, round(avg(hit), 6) AS accuracy, round(sqrt(avg(hit) * (1 - avg(hit)) / count(*)), 6) AS se, round(2.49 * stddev_samp(b) / sqrt(count(*)), 6) AS detectable FROM x GROUP BY division""")
def q_detectable_effect(spark, sf):
    hit = F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    d = forecasts(spark, sf).select("division", hit.alias("hit"), F.pow(F.col("p") - F.col("y"), 2).alias("b"))
    a = F.avg("hit")
    return d.groupBy("division").agg(F.count("*").alias("n"), F.round(a, 6).alias("accuracy"), F.round(F.sqrt(a * (1 - a) / F.count("*")), 6).alias("se"), F.round(2.49 * F.stddev_samp("b") / F.sqrt(F.count("*")), 6).alias("detectable"))


#: Six cells: the side's chance times that of the way, and the cell that came true.
CELLS = CASE + """, s AS (SELECT *, [contest_id % 7 + 1, contest_id % 3 + 1, contest_id % 5 + 2]::DOUBLE[] AS q, CASE method WHEN 'ko' THEN 1 WHEN 'submission' THEN 2 ELSE 3 END AS m FROM f),
g AS (SELECT *, greatest(0.0001, least(0.9999, CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS side_p, q[m] / list_sum(q) AS way_p FROM s)"""


def cells(spark, sf):
    k = F.col("contest_id")
    q = F.array((k % 7 + 1).cast("double"), (k % 3 + 1).cast("double"), (k % 5 + 2).cast("double"))
    m = F.when(F.col("method") == "ko", 0).when(F.col("method") == "submission", 1).otherwise(2)
    d = forecasts(spark, sf).withColumn("q", q).withColumn("m", m)
    side = S.clamp(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), 0.0001, 0.9999)
    return d.withColumn("side_p", side).withColumn("way_p", F.get("q", F.col("m")) / F.aggregate("q", F.lit(0.0), lambda s, x: s + x))


@query(CELLS + "SELECT division, CAST(m AS INTEGER) AS way, count(*) AS n, round(avg(-ln(way_p)), 6) AS log_loss, round(avg(way_p), 6) AS mean_p FROM g GROUP BY ALL")
def q_multiclass_loss(spark, sf):
    return cells(spark, sf).groupBy("division", (F.col("m") + 1).alias("way")).agg(F.count("*").alias("n"), F.round(F.avg(-F.log("way_p")), 6).alias("log_loss"), F.round(F.avg("way_p"), 6).alias("mean_p"))


@query(CELLS + """
SELECT division, round(avg(-ln(side_p * way_p)), 6) AS six, round(avg(-ln(side_p)), 6) AS side, round(avg(-ln(way_p)), 6) AS way,
       round(avg((1 - side_p * way_p) ** 2 - (side_p * way_p) ** 2 + (side_p ** 2 + (1 - side_p) ** 2) * list_sum(list_transform(q, lambda x: (x / list_sum(q)) ** 2))), 6) AS brier FROM g GROUP BY division""")
def q_loss_decomposition(spark, sf):
    """The loss over six cells is that of the side and that of the way given the side, exactly."""
    both = F.col("side_p") * F.col("way_p")
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + x)
    squares = (F.pow("side_p", F.lit(2)) + F.pow(1 - F.col("side_p"), F.lit(2))) * F.aggregate("q", F.lit(0.0), lambda s, x: s + F.pow(x / total, F.lit(2)))
    mean = lambda x: F.round(F.avg(x), 6)
    return cells(spark, sf).groupBy("division").agg(mean(-F.log(both)).alias("six"), mean(-F.log("side_p")).alias("side"), mean(-F.log("way_p")).alias("way"), mean(F.pow(1 - both, F.lit(2)) - F.pow(both, F.lit(2)) + squares).alias("brier"))


@query(PRICED + """
, x AS (SELECT contest_id, p, 1 / price AS market, y, day, division FROM w), s AS (
  SELECT 'favourite' AS probe, CASE WHEN market >= 0.5 THEN p ELSE 1 - p END AS p, CASE WHEN market >= 0.5 THEN market ELSE 1 - market END AS m, CASE WHEN market >= 0.5 THEN y ELSE 1 - y END AS y FROM x
  UNION ALL SELECT 'confident', CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, CASE WHEN p >= 0.5 THEN market ELSE 1 - market END, CASE WHEN p >= 0.5 THEN y ELSE 1 - y END FROM x WHERE abs(p - 0.5) > 0.2
  UNION ALL SELECT 'heavy first side', p, market, y FROM x WHERE division = 'heavy')
SELECT probe, count(*) AS n, round(avg(p), 6) AS model, round(avg(m), 6) AS market, round(avg(y), 6) AS rate FROM s GROUP BY probe HAVING count(*) >= 40""")
def q_bias_probe(spark, sf):
    """The side that a question names: what model and market say of it, and how often it won."""
    m, p, y = 1 / F.col("price"), F.col("p"), F.col("y").cast("double")

    def side(name, first, asked):
        own = F.struct(F.lit(name).alias("probe"), F.when(first, p).otherwise(1 - p).alias("q"), F.when(first, m).otherwise(1 - m).alias("m"), F.when(first, y).otherwise(1 - y).alias("won"))
        return F.when(asked, own)

    probes = F.array_compact(F.array(side("favourite", m >= 0.5, F.lit(True)), side("confident", p >= 0.5, F.abs(p - 0.5) > 0.2), side("heavy first side", F.lit(True), F.col("division") == "heavy")))
    d = priced(spark, sf).select(F.inline(probes))
    return d.groupBy("probe").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("model"), F.round(F.avg("m"), 6).alias("market"), F.round(F.avg("won"), 6).alias("rate")).where("n >= 40")


@query(CASE + """
, d AS (SELECT *, contest_id * 2654435761 % 5 AS fold FROM f), g AS (SELECT division, fold, sum(y) AS s, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT division, sum(s) AS s, sum(n) AS n FROM g GROUP BY division)
SELECT d.contest_id, CAST(d.fold AS INTEGER) AS fold, round((t.s - g.s + 1) / (t.n - g.n + 2), 6) AS p FROM d JOIN g USING (division, fold) JOIN t USING (division)""")
def q_cross_fitted(spark, sf):
    """Each row's rate comes from the other folds of its division: the division's sums less the fold's."""
    d = forecasts(spark, sf).select("contest_id", "division", "y", (F.col("contest_id") * 2654435761 % 5).cast("int").alias("fold"))
    g = d.groupBy("division", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("division")
    rate = g.select("division", "fold", ((F.sum("s").over(every) - F.col("s") + 1) / (F.sum("n").over(every) - F.col("n") + 2)).alias("r"))
    return d.join(F.broadcast(rate), ["division", "fold"]).select("contest_id", "fold", F.round("r", 6).alias("p"))


@query(CASE + f"""
, base AS (SELECT avg(y) AS b, avg(CASE WHEN method IN ('ko', 'submission') THEN 1.0 ELSE 0 END) AS fin FROM f WHERE day < DATE '2000-01-01'),
l AS (SELECT 'side' AS leg, p, y::DOUBLE AS y, b AS base FROM f, base WHERE day >= DATE '2000-01-01' UNION ALL SELECT 'finish', (contest_id * 13 % 97 + 1) / 99.0, CASE WHEN method IN ('ko', 'submission') THEN 1 ELSE 0 END, fin FROM f, base WHERE day >= DATE '2000-01-01')
SELECT leg, count(*) AS n, round(avg({LOSS}), 6) AS log_loss, round(avg({LOSS.replace('p)', 'base)')}), 6) AS base_loss FROM l GROUP BY leg""")
def q_leg_pricing(spark, sf):
    """Each leg's loss against that of the rates before the test days: one row of rates."""
    from ..operators.evaluate import log_loss

    f = forecasts(spark, sf).withColumn("fin", F.when(F.col("method").isin("ko", "submission"), 1.0).otherwise(0.0))
    cut = F.lit("2000-01-01").cast("date")
    base = f.where(F.col("day") < cut).agg(F.avg("y").alias("base_side"), F.avg("fin").alias("base_fin"))
    legs = F.array(F.struct(F.lit("side").alias("leg"), F.col("p").alias("q"), F.col("y").cast("double").alias("won"), F.col("base_side").alias("base")), F.struct(F.lit("finish").alias("leg"), ((F.col("contest_id") * 13 % 97 + 1) / 99).alias("q"), F.col("fin").alias("won"), F.col("base_fin").alias("base")))
    d = f.where(F.col("day") >= cut).crossJoin(F.broadcast(base)).select(F.inline(legs))
    return d.groupBy("leg").agg(F.count("*").alias("n"), F.round(F.avg(log_loss(F.col("q"), F.col("won"))), 6).alias("log_loss"), F.round(F.avg(log_loss(F.col("base"), F.col("won"))), 6).alias("base_loss"))


@query(PRICED + f"""
, c AS (SELECT unnest(['model', 'market', 'mean', 'sharp']) AS blend), x AS (SELECT blend, y, CASE blend WHEN 'model' THEN p WHEN 'market' THEN least(0.99, 1 / price) WHEN 'mean' THEN (p + least(0.99, 1 / price)) / 2 ELSE 1 / (1 + exp(-1.5 * ln(p / (1 - p)))) END AS p FROM w, c),
l AS (SELECT blend, avg({LOSS}) AS loss FROM x GROUP BY blend)
SELECT blend, round(loss, 6) AS loss, loss = (SELECT min(loss) FROM l) AS chosen FROM l""")
def q_blend_selection(spark, sf):
    from ..operators.evaluate import log_loss

    p, m = F.col("p"), F.least(F.lit(0.99), 1 / F.col("price"))
    sharp = 1 / (1 + F.exp(-1.5 * F.log(p / (1 - p))))
    blends = {"model": p, "market": m, "mean": (p + m) / 2, "sharp": sharp}
    # one pass and one row of sums: a loss that is summed twice may differ from itself in its last digits
    losses = priced(spark, sf).agg(F.count("y").alias("n"), *[F.avg(log_loss(q, F.col("y"))).alias(n) for n, q in blends.items()]).where("n > 0")
    each = losses.select(F.least(*blends).alias("least"), F.inline(F.array(*[F.struct(F.lit(n).alias("blend"), F.col(n).alias("l")) for n in blends])))
    return each.select("blend", F.round("l", 6).alias("loss"), (F.col("l") == F.col("least")).alias("chosen"))


@query(CASE + """
, e AS (SELECT division, round, count(*) FILTER (method = 'ko') AS k, sum(seconds + 1) AS x FROM f GROUP BY ALL), t AS (SELECT division, sum(k) / sum(x) AS base FROM e GROUP BY division)
SELECT e.division, e.round, k, CAST(x AS BIGINT) AS exposure, round(k / x * 300, 6) AS rate, round(ln(greatest(k, 0.5) / x / base), 6) AS effect FROM e JOIN t ON t.division = e.division""")
def q_rate_with_exposure(spark, sf):
    """Events over the time at risk; with one factor the fitted rates are those of its groups."""
    e = forecasts(spark, sf).groupBy("division", "round").agg(F.count(F.when(F.col("method") == "ko", 1)).alias("k"), F.sum(F.col("seconds") + 1).cast("long").alias("exposure"))
    every = Window.partitionBy("division")
    base = F.sum("k").over(every) / F.sum("exposure").over(every)
    return e.withColumn("base", base).select("division", "round", "k", "exposure", F.round(F.col("k") / F.col("exposure") * 300, 6).alias("rate"), F.round(F.log(F.greatest(F.col("k").cast("double"), F.lit(0.5)) / F.col("exposure") / F.col("base")), 6).alias("effect"))


@query()
def q_offset_logit(spark, sf):
    """One intercept for each division over the model's own logit, its slope held at 1."""
    f = forecasts(spark, sf).select("division", "y", S.logit(F.col("p")).alias("z"))
    fit = R.fit_glm(f, "logit", "y", [], ["division"], offset="z")
    return fit.select("division", F.round(F.get("coefs", F.lit(0)), 6).alias("shift"))


@query("""
WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'purchase') AS bought, sum(value) FILTER (event_type = 'purchase') AS spent, count(DISTINCT CAST(ts AS DATE)) AS days, max(value) AS top FROM events GROUP BY user_id),
a AS (SELECT user_id, unnest([CASE WHEN n >= 1 THEN 'first' END, CASE WHEN n >= 50 THEN 'regular' END, CASE WHEN n >= 80 THEN 'devoted' END, CASE WHEN kinds >= 5 THEN 'explorer' END, CASE WHEN bought >= 1 THEN 'buyer' END, CASE WHEN bought >= 15 THEN 'collector' END,
  CASE WHEN spent >= 1000 THEN 'spender' END, CASE WHEN days >= 20 THEN 'daily' END, CASE WHEN top >= 150 THEN 'high roller' END, CASE WHEN bought = 0 THEN 'watcher' END]) AS slug FROM u)
SELECT user_id, slug FROM a WHERE slug IS NOT NULL""")
def q_achievements(spark, sf):
    """Ten rules over six figures of each user."""
    bought = F.col("event_type") == "purchase"
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.count(F.when(bought, 1)).alias("bought"), F.sum(F.when(bought, F.col("value"))).alias("spent"), F.countDistinct(F.to_date("ts")).alias("days"), F.max("value").alias("top"))
    rules = {"first": "n >= 1", "regular": "n >= 50", "devoted": "n >= 80", "explorer": "kinds >= 5", "buyer": "bought >= 1", "collector": "bought >= 15", "spender": "spent >= 1000", "daily": "days >= 20", "high roller": "top >= 150", "watcher": "bought = 0"}
    return u.select("user_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), slug) for slug, rule in rules.items()]))).alias("slug"))


@query(BET + """
SELECT parlay, count(*) AS legs, count(*) FILTER (status = 'won') AS won, CAST(min(stake) AS BIGINT) AS stake, string_agg(contest_id || ' ' || code || ' ' || status, '; ' ORDER BY contest_id) AS text FROM graded GROUP BY parlay""")
def q_parlay_view(spark, sf):
    """A header and its legs in order."""
    line = F.concat_ws(" ", F.col("contest_id").cast("string"), "code", "status")
    own = F.transform(F.array_sort(F.collect_list(F.struct("contest_id", line.alias("l")))), lambda r: r["l"])
    return graded(spark, sf).groupBy("parlay").agg(F.count("*").alias("legs"), F.count(F.when(F.col("status") == "won", 1)).alias("won"), F.min("stake").alias("stake"), F.array_join(own, "; ").alias("text"))


@query(BET + """
, c AS (SELECT contest_id, day, division FROM contest), g AS (SELECT graded.*, c.day, c.division, row_number() OVER (PARTITION BY c.division ORDER BY c.day DESC, graded.contest_id DESC) AS k FROM graded JOIN c ON c.contest_id = graded.contest_id)
SELECT contest_id, day, division, code, status, CASE status WHEN 'won' THEN round(stake * price, 2) WHEN 'void' THEN stake ELSE 0 END::DOUBLE AS back FROM g WHERE k <= 50""")
def q_bets_in_context(spark, sf):
    """The latest bets of each division with their contest and what they gave back; a void one gives the stake back."""
    c = contests(spark, sf).select("contest_id", "day", "division")
    d = graded(spark, sf).join(c, "contest_id").withColumn("k", F.row_number().over(Window.partitionBy("division").orderBy(F.desc("day"), F.desc("contest_id")))).where("k <= 50")
    back = F.when(F.col("status") == "won", F.round(F.col("stake") * F.col("price"), 2)).when(F.col("status") == "void", F.col("stake").cast("double")).otherwise(0.0)
    return d.select("contest_id", "day", "division", "code", "status", back.alias("back"))


@query(BET + """
, before AS (SELECT contest_id, CASE WHEN contest_id % 4 = 0 THEN NULL ELSE winner_id END AS winner, CASE WHEN contest_id % 6 = 0 THEN NULL ELSE method END AS method FROM contest),
changed AS (SELECT c.contest_id FROM contest c JOIN before b USING (contest_id) WHERE c.winner_id IS DISTINCT FROM b.winner OR c.method IS DISTINCT FROM b.method)
SELECT contest_id, code, status FROM graded WHERE contest_id IN (SELECT contest_id FROM changed) AND status <> 'open'""")
def q_graded_on_change(spark, sf):
    """Bets of the contests whose winner or method is another than before: only they are graded anew."""
    k = F.col("contest_id")
    now = contests(spark, sf).select("contest_id", "winner_id", "method")
    before = now.select("contest_id", F.when(k % 4 != 0, F.col("winner_id")).alias("w"), F.when(k % 6 != 0, F.col("method")).alias("m"))
    changed = now.join(before, "contest_id").where(~F.col("winner_id").eqNullSafe(F.col("w")) | ~F.col("method").eqNullSafe(F.col("m"))).select("contest_id")
    return graded(spark, sf).where("status <> 'open'").join(changed, "contest_id", "left_semi").select("contest_id", "code", "status")


@query(CONTEST + """
, h AS (SELECT entity, contest_id, day, count(*) OVER w AS bouts, round(avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0 END) OVER w, 6) AS rate, row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS k FROM side WINDOW w AS (PARTITION BY entity ORDER BY day, contest_id))
SELECT x.entity AS a, y.entity AS b, x.contest_id AS a_after, y.contest_id AS b_after, x.bouts AS a_bouts, y.bouts AS b_bouts, round(x.rate - y.rate, 6) AS d_rate, 90 AS layoff FROM h x JOIN h y ON y.entity = x.entity + 1 AND y.k = 1 WHERE x.k = 2""")
def q_custom_pair(spark, sf):
    """Pairs that never met, each side as it was after a contest of its own, with a nominal layoff."""
    w = Window.partitionBy("entity").orderBy("day", "contest_id")
    h = perspectives(spark, sf).select("entity", "contest_id", F.count("*").over(w).alias("bouts"), F.round(F.avg(F.when(F.col("result") == "W", 1.0).otherwise(0.0)).over(w), 6).alias("rate"), F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("day"), F.desc("contest_id"))).alias("k"))
    x = h.where("k = 2").select(F.col("entity").alias("a"), F.col("contest_id").alias("a_after"), F.col("bouts").alias("a_bouts"), F.col("rate").alias("ra"))
    y = h.where("k = 1").select((F.col("entity") - 1).alias("a"), F.col("entity").alias("b"), F.col("contest_id").alias("b_after"), F.col("bouts").alias("b_bouts"), F.col("rate").alias("rb"))
    return x.join(y, "a").select("a", "b", "a_after", "b_after", "a_bouts", "b_bouts", F.round(F.col("ra") - F.col("rb"), 6).alias("d_rate"), F.lit(90).alias("layoff"))


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta[^>]*property="og:image"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<meta[^>]*name="twitter:image"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<img[^>]*src="([^"]*)"', 1), ''), '') AS image,
       nullif(regexp_extract(html, '<html[^>]*lang="([a-z]+)', 1), '') AS lang FROM pages""")
def q_page_meta(spark, sf):
    """The image that a page names first in one of three ways, and its language."""
    found = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    image = F.coalesce(found('<meta[^>]*property="og:image"[^>]*content="([^"]*)"'), found('<meta[^>]*name="twitter:image"[^>]*content="([^"]*)"'), found('<img[^>]*src="([^"]*)"'), F.lit(""))
    return table(spark, sf, "pages").select("page_id", image.alias("image"), found('<html[^>]*lang="([a-z]+)').alias("lang"))


@query("""
WITH t AS (SELECT o_orderkey, (['Ann Lee vs. Bo Ray | full fight', 'Bo Ray v Cy Poe (highlights)', 'Interview: Ann Lee', 'CY POE VS ANN LEE'])[o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN ' 1998' ELSE '' END AS title FROM orders),
p AS (SELECT o_orderkey, title, regexp_extract(lower(title), '^([a-z ]+?) vs?\\.? ([a-z]+ [a-z]+)', ['x', 'y']) AS m FROM t)
SELECT o_orderkey, nullif(m.x, '') AS first, nullif(m.y, '') AS second, CASE WHEN lower(title) LIKE '%highlight%' THEN 'short' WHEN lower(title) LIKE '%full%' THEN 'full' END AS hint, TRY_CAST(nullif(regexp_extract(title, '(\\d{4})$', 1), '') AS INTEGER) AS year FROM p""")
def q_title_pairs(spark, sf):
    """Both names, a hint and a year from a title."""
    k = F.col("o_orderkey")
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Ann Lee vs. Bo Ray | full fight", "Bo Ray v Cy Poe (highlights)", "Interview: Ann Lee", "CY POE VS ANN LEE"))), (k % 4 + 1).cast("int")), F.when(k % 3 == 0, " 1998").otherwise(""))
    t = table(spark, sf, "orders").select(k, title.alias("title"))
    name = lambda i: F.nullif(F.regexp_extract(F.lower("title"), r"^([a-z ]+?) vs?\.? ([a-z]+ [a-z]+)", i), F.lit(""))
    hint = F.when(F.contains(F.lower("title"), F.lit("highlight")), "short").when(F.contains(F.lower("title"), F.lit("full")), "full")
    return t.select("o_orderkey", name(1).alias("first"), name(2).alias("second"), hint.alias("hint"), F.nullif(F.regexp_extract("title", r"(\d{4})$", 1), F.lit("")).cast("int").alias("year"))


@query("""
WITH m AS (SELECT l_orderkey AS contest_id, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, (o_orderkey % 5 + 1) * 30.0 AS needed, m.q, m.n FROM orders LEFT JOIN m ON contest_id = o_orderkey)
SELECT o_orderkey, CASE WHEN q IS NULL THEN 'no rows' WHEN q < needed - 20 THEN 'too short' WHEN q > needed + 60 THEN 'too long' WHEN n < 2 THEN 'one part' ELSE 'accepted' END AS verdict FROM r""")
def q_manifest(spark, sf):
    """Sums of parts against what is needed, with some slack, and why a row is refused."""
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    r = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 5 + 1) * 30.0).alias("needed")).join(m, "o_orderkey", "left")
    verdict = F.when(F.col("q").isNull(), "no rows").when(F.col("q") < F.col("needed") - 20, "too short").when(F.col("q") > F.col("needed") + 60, "too long").when(F.col("n") < 2, "one part").otherwise("accepted")
    return r.select("o_orderkey", verdict.alias("verdict"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 30 AS tier, (o_orderkey % 97 + 1) / 99.0 AS p, [1.5 + o_orderkey % 5 * 0.3, 2.0 + o_orderkey % 3, 3.0 + o_orderkey % 7 * 0.5]::DOUBLE[] AS prices FROM orders)
SELECT k, CASE WHEN tier >= 25 THEN 0.3 WHEN tier >= 22 THEN 0.45 WHEN tier >= 14 THEN 0.6 WHEN tier >= 8 THEN 0.75 WHEN tier >= 3 THEN 0.9 ELSE 1 END::DOUBLE AS severity,
       round(CASE WHEN k % 2 = 0 THEN 1.15 WHEN k % 3 = 0 THEN 0.9 + 0.1 * least(2, greatest(0, k % 7 / 2.0)) ELSE 1 END::DOUBLE, 6) AS quality, CAST(CASE WHEN k % 20 <= 5 THEN 22 WHEN k % 20 <= 10 THEN 14 WHEN k % 20 <= 15 THEN 8 ELSE 0 END AS INTEGER) AS points,
       round(1 / (1 + exp(-(k % 101 - 50) / 20.0)), 6) AS forecast, round((k % 10 / 10.0 * (k % 7) + 0.5 * 4) / (k % 7 + 4), 6)::DOUBLE AS shrunk,
       round(1 / (1 + exp(-(0.9 * ln(p / (1 - p)) + CASE WHEN k % 4 = 0 THEN 0 ELSE k % 5 * 0.1 END))), 6) AS corrected,
       round(CASE WHEN list_sum(list_transform(prices, lambda x: 1 / x)) BETWEEN 1 AND 1.6 THEN 1 / prices[1] / list_sum(list_transform(prices, lambda x: 1 / x)) END, 6) AS share FROM o""")
def q_scalar_rules(spark, sf):
    """Severity of a loss, quality of a win, points of a rank, a forecast, a shrunk rate, a corrected probability and a share of a book."""
    from ..functions import odds as O

    k = F.col("k")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    margin, shift = F.when(k % 3 == 0, k % 7 / 2), F.when(k % 4 != 0, k % 5)
    prices = F.array(1.5 + k % 5 * 0.3, 2.0 + k % 3, 3.0 + k % 7 * 0.5)
    p = (k % 97 + 1) / 99
    return d.select(
        "k", S.loss_severity(k % 30).cast("double").alias("severity"), F.round(S.win_quality(k % 2 == 0, margin), 6).alias("quality"), S.rank_points(k % 20).alias("points"), F.round(O.forecast((k % 101 - 50).cast("double"), 20.0), 6).alias("forecast"),
        F.round(S.shrink(k % 10 / 10, k % 7, 0.5, 4), 6).alias("shrunk"), F.round(S.corrected(p, 0.9, [(shift, 0.1)]), 6).alias("corrected"), F.round(F.get(O.devig_many(prices), 0), 6).alias("share"),
    )
