"""Lists, boards and detail pages: what a reader of the results asks for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import history as H
from .base import AS_OF, CONTEST, contests, perspectives, table
from .registry import SQL, query

ORDER = ["day", "contest_id"]
#: Contests from this day on are announced, not held.
NOW = "2000-06-01"


def held(df):
    return df.where(F.col("day") < F.lit(NOW).cast("date"))


def ahead(df):
    return df.where(F.col("day") >= F.lit(NOW).cast("date"))


@query(CONTEST + f"SELECT entity, contest_id, opponent, result FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) AS rn FROM side WHERE day < DATE '{NOW}' AND result <> 'D') WHERE rn <= 20")
def q_form_picker(spark, sf):
    """The latest twenty held contests with a result of each entity."""
    return H.last_n(held(perspectives(spark, sf)).where("result <> 'D'"), "entity", ORDER, 20).select("entity", "contest_id", "opponent", "result")


@query(CONTEST + f"""
SELECT entity, contest_id, CASE WHEN day < DATE '{NOW}' THEN 'held' ELSE 'ahead' END AS part, CASE WHEN day < DATE '{NOW}' THEN result END AS result, CAST(row_number() OVER (PARTITION BY entity, day < DATE '{NOW}' ORDER BY CASE WHEN day < DATE '{NOW}' THEN -epoch(day::TIMESTAMP) ELSE epoch(day::TIMESTAMP) END, contest_id) AS INTEGER) AS place FROM side""")
def q_history_and_ahead(spark, sf):
    """Held contests newest first and announced ones soonest first, in one list."""
    past = F.col("day") < F.lit(NOW).cast("date")
    n = F.datediff("day", F.lit("1970-01-01"))
    d = perspectives(spark, sf).withColumn("past", past)
    w = Window.partitionBy("entity", "past").orderBy(F.when(past, -n).otherwise(n), "contest_id")
    return d.select("entity", "contest_id", F.when(past, "held").otherwise("ahead").alias("part"), F.when(past, F.col("result")).alias("result"), F.row_number().over(w).alias("place"))


@query(CONTEST + """
, asked AS (SELECT least(a_id, b_id) AS x, greatest(a_id, b_id) AS y, CASE WHEN contest_id % 3 > 0 THEN division END AS cut, contest_id, day FROM contest),
newest AS (SELECT x, y, cut, max(struct_pack(day := day, contest_id := contest_id)) AS m FROM asked GROUP BY ALL)
SELECT a.contest_id, m.contest_id AS newest FROM asked a JOIN newest n ON a.x = n.x AND a.y = n.y AND a.cut IS NOT DISTINCT FROM n.cut""")
def q_pair_cached(spark, sf):
    """The newest entry of each pair in either order, where a missing cut equals a missing cut."""
    cut = F.when(F.col("contest_id") % 3 > 0, F.col("division"))
    asked = contests(spark, sf).select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"), cut.alias("cut"), "contest_id", "day")
    newest = F.max(F.struct("day", "contest_id")).over(Window.partitionBy("x", "y", "cut"))
    return asked.select("contest_id", newest["contest_id"].alias("newest"))


@query(CONTEST + f"""
, e AS (SELECT day, count(*) AS contests, count(*) FILTER (winner_id IS NOT NULL) AS decided, count(*) FILTER (scheduled = 5) AS long FROM contest GROUP BY day), f AS (SELECT unnest(['all', 'past', 'upcoming']) AS filter)
SELECT filter, day, contests, decided, long FROM e, f WHERE filter = 'all' OR (filter = 'past' AND day < DATE '{NOW}') OR (filter = 'upcoming' AND day >= DATE '{NOW}')""")
def q_event_list(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    e = contests(spark, sf).groupBy("day").agg(F.count("*").alias("contests"), n(F.col("winner_id").isNotNull()).alias("decided"), n(F.col("scheduled") == 5).alias("long"))
    part = F.when(F.col("day") < F.lit(NOW).cast("date"), "past").otherwise("upcoming")
    return e.select(F.explode(F.array(F.lit("all"), part)).alias("filter"), "day", "contests", "decided", "long")


@query(CONTEST + f"""
, n AS (SELECT min(day) AS day FROM contest WHERE day >= DATE '{NOW}')
SELECT day, contest_id, a_id, b_id, contests FROM (SELECT c.*, row_number() OVER (ORDER BY scheduled DESC, purse DESC, contest_id) AS k, count(*) OVER () AS contests FROM contest c JOIN n USING (day)) WHERE k = 1""")
def q_next_event(spark, sf):
    """The soonest day ahead with its main pair: one day's contests, chosen before they are ranked."""
    c = ahead(contests(spark, sf))
    day = c.agg(F.min("day").alias("day"))
    rows = c.join(F.broadcast(day), "day")
    best = F.min(F.struct((-F.col("scheduled")).alias("s"), (-F.col("purse")).alias("p"), "contest_id", "day", "a_id", "b_id")).alias("m")
    return rows.agg(best, F.count("*").alias("contests")).where("contests > 0").select("m.day", "m.contest_id", "m.a_id", "m.b_id", "contests")


@query(CONTEST + f"""
, q AS (SELECT l_orderkey AS contest_id, max(struct_pack(at := l_shipdate, p := l_extendedprice, l := l_linenumber)) AS q FROM lineitem GROUP BY 1),
first AS (SELECT entity, min(struct_pack(day := day, contest_id := contest_id)) AS f FROM side GROUP BY entity),
b AS (SELECT c.contest_id, c.day, round(1 + q.q.p / 40000, 4) AS price, fa.f.contest_id = c.contest_id OR fb.f.contest_id = c.contest_id AS debut FROM contest c LEFT JOIN q USING (contest_id) JOIN first fa ON fa.entity = a_id JOIN first fb ON fb.entity = b_id WHERE c.day >= DATE '{NOW}')
SELECT day, count(*) AS contests, count(price) AS priced, count(*) FILTER (debut) AS debuts, count(*) FILTER (price BETWEEN 1.2 AND 3 AND NOT debut) AS open, string_agg(CAST(contest_id AS VARCHAR), ',' ORDER BY contest_id) FILTER (price BETWEEN 1.2 AND 3 AND NOT debut) AS open_ids FROM b GROUP BY day""")
def q_board_by_event(spark, sf):
    """Announced contests with their newest price, a flag for first contests and a gate, one row a day."""
    newest = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.max(F.struct("l_shipdate", "l_extendedprice", "l_linenumber"))["l_extendedprice"].alias("p"))
    sides = perspectives(spark, sf)
    first = F.min(F.struct("day", "contest_id")).over(Window.partitionBy("entity"))["contest_id"] == F.col("contest_id")
    debuts = sides.select("contest_id", "day", first.alias("first")).groupBy("contest_id", "day").agg(F.bool_or("first").alias("debut"))
    b = ahead(debuts).join(newest, "contest_id", "left").withColumn("price", F.round(1 + F.col("p") / 40000, 4))
    opens = F.coalesce(F.col("price").between(1.2, 3.0), F.lit(False)) & ~F.col("debut")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(opens, F.col("contest_id")))), lambda x: x.cast("string")), ",")
    n = lambda c: F.count(F.when(c, 1))
    return b.groupBy("day").agg(F.count("*").alias("contests"), F.count("price").alias("priced"), n(F.col("debut")).alias("debuts"), n(opens).alias("open"), F.when(n(opens) > 0, ids).alias("open_ids"))


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id, event_id % 3 > 0 AS seen FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) FILTER (NOT seen) OVER (PARTITION BY user_id) AS unread FROM e)
SELECT user_id, event_id, event_type, seen, unread FROM r WHERE k <= 10""")
def q_notifications(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", (F.col("event_id") % 3 > 0).alias("seen"))
    unread = F.count(F.when(~F.col("seen"), 1)).over(Window.partitionBy("user_id"))
    return H.last_n(e.withColumn("unread", unread), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "event_type", "seen", "unread")


@query("""
SELECT n_nationkey, n_name, coalesce(k, 0) AS entries, coalesce(best, 0) AS best FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k, round(max(c_acctbal), 2) AS best FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey""")
def q_lists_with_counts(spark, sf):
    entries = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"), F.round(F.max("c_acctbal"), 2).alias("best"))
    return table(spark, sf, "nation").join(entries, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("k", F.lit(0)).alias("entries"), F.coalesce("best", F.lit(0.0)).alias("best"))


@query("""
WITH q AS (SELECT conv_id, turn, role, text, CASE WHEN length(text) % 5 = 0 THEN 'pending' WHEN length(text) % 5 < 3 THEN 'approved' ELSE 'rejected' END AS status FROM conversations)
SELECT conv_id, turn, CASE WHEN status = 'pending' AND length(text) < 200 THEN 'approved' ELSE status END AS status, count(*) FILTER (status = 'pending') OVER (PARTITION BY role) AS waiting FROM q""")
def q_moderation_queue(spark, sf):
    """Short pending rows are approved; every row knows how many of its kind waited."""
    n = F.char_length("text")
    q = table(spark, sf, "conversations").withColumn("status", F.when(n % 5 == 0, "pending").when(n % 5 < 3, "approved").otherwise("rejected"))
    waiting = q.groupBy("role").agg(F.count(F.when(F.col("status") == "pending", 1)).alias("waiting"))
    return q.join(F.broadcast(waiting), "role").select("conv_id", "turn", F.when((F.col("status") == "pending") & (n < 200), "approved").otherwise(F.col("status")).alias("status"), "waiting")


@query("""
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) AS rank FROM x)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, round(v::DOUBLE, 5) AS v FROM r WHERE rank <= 3""")
def q_top_attributions(spark, sf):
    """The three largest figures of each row by size, ranked from 1: chosen within the row's array, nothing is shuffled."""
    items = F.transform("embedding", lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("pos"), v.alias("v")))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice(F.array_sort(items), 1, 3)).alias("i", "e")).select("vec_id", (F.col("i") + 1).alias("rank"), "e.pos", F.round(F.col("e.v").cast("double"), 5).alias("v"))


@query(CONTEST + """
, f AS (SELECT entity, division, min(day) AS first_win, max(day) AS latest_win FROM side WHERE result = 'W' GROUP BY ALL)
SELECT f.entity, f.division, first_win, latest_win, min(s.day) FILTER (result = 'L' AND s.day > first_win) AS first_loss_after, count(*) FILTER (result = 'W' AND s.day > first_win AND s.day < latest_win) AS wins_between
FROM f JOIN side s ON s.entity = f.entity AND s.division = f.division GROUP BY ALL""")
def q_interval_counts(spark, sf):
    """First loss after the first win, and the wins between the first and the latest, by entity and division."""
    by = Window.partitionBy("entity", "division")
    won = F.when(F.col("result") == "W", F.col("day"))
    d = perspectives(spark, sf).withColumn("first_win", F.min(won).over(by)).withColumn("latest_win", F.max(won).over(by)).where("first_win is not null")
    after = F.col("day") > F.col("first_win")
    return d.groupBy("entity", "division", "first_win", "latest_win").agg(F.min(F.when((F.col("result") == "L") & after, F.col("day"))).alias("first_loss_after"), F.count(F.when((F.col("result") == "W") & after & (F.col("day") < F.col("latest_win")), 1)).alias("wins_between"))


@query(CONTEST + f"""
SELECT c_custkey AS entity, coalesce(CAST(max(day) AS VARCHAR), '') AS last_day, coalesce(max(day), DATE '1970-01-01') < DATE '{AS_OF}' - INTERVAL 18 MONTH AS stale, count(contest_id) = 0 AS empty
FROM customer LEFT JOIN side ON entity = c_custkey GROUP BY c_custkey""")
def q_stale_and_empty(spark, sf):
    last = perspectives(spark, sf).groupBy("entity").agg(F.max("day").alias("last"))
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")).join(last, "entity", "left")
    epoch = F.lit("1970-01-01").cast("date")
    return d.select("entity", F.coalesce(F.col("last").cast("string"), F.lit("")).alias("last_day"), (F.coalesce("last", epoch) < S.months_ago(F.lit(AS_OF).cast("date"), 18)).alias("stale"), F.col("last").isNull().alias("empty"))


@query(CONTEST + """
, k AS (SELECT contest_id, any_value(division) AS division, any_value(method) AS method, any_value(winner_id) AS winner, count(l_orderkey) AS lines FROM contest LEFT JOIN lineitem ON l_orderkey = contest_id GROUP BY contest_id)
SELECT division, count(*) AS n, count(method) AS with_method, count(*) FILTER (lines = 0) AS without_lines, round(count(winner) / count(*), 6) AS decided FROM k GROUP BY division HAVING count(*) FILTER (lines = 0) >= 0""")
def q_coverage(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.count("*").alias("lines"))
    k = contests(spark, sf).join(lines, "contest_id", "left")
    return k.groupBy("division").agg(F.count("*").alias("n"), F.count("method").alias("with_method"), F.count(F.when(F.col("lines").isNull(), 1)).alias("without_lines"), F.round(F.count("winner_id") / F.count("*"), 6).alias("decided"))


@query("""
WITH k AS (SELECT l_suppkey, max(struct_pack(at := l_shipdate, o := l_orderkey, p := l_partkey, l := l_linenumber)) AS m FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, m.o AS newest_order, m.p AS newest_part FROM supplier LEFT JOIN k ON l_suppkey = s_suppkey""")
def q_targets_with_newest(spark, sf):
    newest = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber")).alias("m"))
    return table(spark, sf, "supplier").join(newest, "s_suppkey", "left").select("s_suppkey", "s_name", F.col("m.l_orderkey").alias("newest_order"), F.col("m.l_partkey").alias("newest_part"))


@query("""
WITH m AS (SELECT user_id, event_id, value AS x, (event_id % 50)::DOUBLE AS y, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame FROM events),
f AS (SELECT user_id, frame, avg(x) AS x, avg(y) AS y FROM m GROUP BY ALL),
s AS (SELECT *, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, count(*) AS steps, round(median(step), 6) AS movement FROM s WHERE gap = 1 GROUP BY user_id""")
def q_track_movement(spark, sf):
    """Median step between frames that follow each other; gaps are no steps."""
    e = table(spark, sf, "events").select("user_id", F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), F.floor(F.unix_timestamp("ts") / 3600).alias("frame"))
    f = e.groupBy("user_id", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    w = Window.partitionBy("user_id").orderBy("frame")
    s = f.select("user_id", (F.col("frame") - F.lag("frame").over(w)).alias("gap"), F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step"))
    return s.where("gap = 1").groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.median("step"), 6).alias("movement"))


@query("""
SELECT vec_id, round(sqrt((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2), 5) AS span, round((e[1] + e[3]) / 2, 5) AS mid_x, round((e[2] + e[4]) / 2, 5) AS mid_y, round(degrees(atan2(e[4] - e[2], e[3] - e[1])), 4) AS tilt,
       round(cos(e[5] * 2 * pi()) * abs(e[6]), 5) AS hue_x, round(sin(e[5] * 2 * pi()) * abs(e[6]), 5) AS hue_y FROM (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 4)) AS e FROM embeddings)""")
def q_geometry(spark, sf):
    """Span, middle and tilt of two points, and a hue as a point on a circle, weighted by its saturation."""
    import math

    e = F.transform("embedding", lambda v: F.round(v.cast("double"), 4))
    d = table(spark, sf, "embeddings").select("vec_id", *[F.get(e, i).alias(f"e{i}") for i in range(6)])
    turn = F.col("e4") * 2 * math.pi
    return d.select(
        "vec_id", F.round(F.hypot(F.col("e0") - F.col("e2"), F.col("e1") - F.col("e3")), 5).alias("span"), F.round((F.col("e0") + F.col("e2")) / 2, 5).alias("mid_x"), F.round((F.col("e1") + F.col("e3")) / 2, 5).alias("mid_y"),
        F.round(F.degrees(F.atan2(F.col("e3") - F.col("e1"), F.col("e2") - F.col("e0"))), 4).alias("tilt"), F.round(F.cos(turn) * F.abs("e5"), 5).alias("hue_x"), F.round(F.sin(turn) * F.abs("e5"), 5).alias("hue_y"),
    )


@query("""
WITH q AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) AS d, sum(l_tax) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_max(d) <> list_min(d) OR round(t, 2) > 0.3 AS priced, len(list_filter(d, lambda x: x > 0.05)) AS above FROM q""")
def q_priced_market(spark, sf):
    """A market counts as priced if its prices differ or enough was traded."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"), F.sum("l_tax").alias("t"))
    return q.select("l_orderkey", (F.exists("d", lambda x: x != F.get("d", 0)) | (F.round("t", 2) > 0.3)).alias("priced"), F.size(F.filter("d", lambda x: x > 0.05)).cast("long").alias("above"))


WEIGHTS = [0.8, -0.5, 0.3, 1.2]


@query(f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 4)) AS e FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-greatest(-30, least(30, 10 * ({' + '.join(f'{w} * e[{i + 1}]' for i, w in enumerate(WEIGHTS))}))))), 6) AS p FROM x""")
def q_decision_model(spark, sf):
    """A logit without an intercept over scaled differences, clipped; what is no number gives one half."""
    dot = sum((F.lit(w) * F.round(F.get("embedding", i).cast("double"), 4) for i, w in enumerate(WEIGHTS)), F.lit(0.0))
    p = 1 / (1 + F.exp(-S.clamp(10 * dot, -30.0, 30.0)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.when(F.isnan(dot) | dot.isNull(), F.lit(0.5)).otherwise(p), 6).alias("p"))


CATEGORY = {"punch": "ko", "ko": "ko", "tko": "ko", "choke": "submission", "lock": "submission", "decision": "decision", "points": "decision"}


@query("""
WITH r AS (SELECT o_orderkey, (['KO (punch)', 'Rear choke', 'Decision - split', 'TKO', 'on points', 'No Contest', ''])[o_orderkey % 7 + 1] AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN lower(raw) LIKE '%punch%' OR lower(raw) LIKE '%ko%' THEN 'ko' WHEN lower(raw) LIKE '%choke%' OR lower(raw) LIKE '%lock%' THEN 'submission' WHEN lower(raw) LIKE '%decision%' OR lower(raw) LIKE '%points%' THEN 'decision' END AS method FROM r""")
def q_method_backfill(spark, sf):
    """Raw text to a category: the first entry of the map whose word is in it."""
    raw = F.element_at(F.array(*map(F.lit, ("KO (punch)", "Rear choke", "Decision - split", "TKO", "on points", "No Contest", ""))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    d = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return d.select("o_orderkey", "raw", F.coalesce(*[F.when(F.contains(F.lower("raw"), F.lit(w)), c) for w, c in CATEGORY.items()]).alias("method"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS top3 FROM p WHERE k <= 3 GROUP BY o_custkey""")
def q_ordered_ids(spark, sf):
    own = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), 1, 3)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(own, lambda r: r["k"].cast("string")), ",").alias("top3"))


@query(CONTEST + """
, d AS (SELECT entity, list_sort(list_distinct(list(division))) AS d FROM side GROUP BY entity)
SELECT entity, array_to_string(d, ',') AS divisions, len(d) AS n FROM d WHERE list_contains(d, 'heavy')""")
def q_array_membership(spark, sf):
    d = perspectives(spark, sf).groupBy("entity").agg(F.array_sort(F.collect_set("division")).alias("d"))
    return d.where(F.array_contains("d", "heavy")).select("entity", F.array_join("d", ",").alias("divisions"), F.size("d").cast("long").alias("n"))


@query(CONTEST + """
SELECT contest_id, '{"a":{"id":' || a_id || ',"won":' || CASE WHEN coalesce(winner_id = a_id, false) THEN 'true' ELSE 'false' END || '},"b":{"id":' || b_id || ',"won":' || CASE WHEN coalesce(winner_id = b_id, false) THEN 'true' ELSE 'false' END || '}}' AS sides FROM contest""")
def q_json_sides(spark, sf):
    """Both sides as one JSON object."""
    side = lambda c: F.struct(F.col(c).alias("id"), F.coalesce(F.col("winner_id") == F.col(c), F.lit(False)).alias("won"))
    return contests(spark, sf).select("contest_id", F.to_json(F.struct(side("a_id").alias("a"), side("b_id").alias("b"))).alias("sides"))


@query(CONTEST + """
, c AS (SELECT day, division, string_agg(a_id || '-' || b_id, ' ' ORDER BY contest_id) AS pairs, count(*) AS n FROM contest GROUP BY ALL)
SELECT day, string_agg(division || '(' || n || '): ' || pairs, '; ' ORDER BY division) AS card, CAST(sum(n) AS BIGINT) AS contests FROM c GROUP BY day""")
def q_event_tree(spark, sf):
    """Day, divisions and pairs as one nested value, written out."""
    pair = F.concat(F.col("a_id").cast("string"), F.lit("-"), F.col("b_id").cast("string"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("contest_id", pair.alias("p")))), lambda r: r["p"])
    c = contests(spark, sf).groupBy("day", "division").agg(F.array_join(own, " ").alias("pairs"), F.count("*").alias("n"))
    line = F.concat("division", F.lit("("), F.col("n").cast("string"), F.lit("): "), "pairs")
    return c.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("division", line.alias("l")))), lambda r: r["l"]), "; ").alias("card"), F.sum("n").alias("contests"))


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (len(t) > 3) AS many, count(*) FILTER (list_max(t) > 40000) AS dear, count(*) FILTER (len(list_filter(t, lambda x: x < 5000)) > 0) AS cheap FROM (
  SELECT o_orderkey, any_value(o_orderpriority) AS o_orderpriority, list(l_extendedprice) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY 1""")
def q_index_summary(spark, sf):
    """Counts by predicates over nested rows."""
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_extendedprice").alias("t"))
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, sf, "orders").join(nested, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), n(F.size("t") > 3).alias("many"), n(F.array_max("t") > 40000).alias("dear"), n(F.exists("t", lambda x: x < 5000)).alias("cheap"))


# Sorting and limits


@query(CONTEST + """
, r AS (SELECT entity, count(*) AS n, count(*) FILTER (result = 'W') / count(*) AS rate, max(day) AS last FROM side GROUP BY entity)
SELECT entity, round(key, 6) AS key FROM (SELECT entity, rate * least(1, n / 12) * CASE WHEN last >= DATE '2001-01-01' THEN 1.0 WHEN last >= DATE '2000-01-01' THEN 0.7 ELSE 0.4 END AS key FROM r) ORDER BY round(key, 9) DESC, entity LIMIT 25""")
def q_expression_sort(spark, sf):
    """Win rate by credibility by recency, the first 25."""
    r = perspectives(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), (F.count(F.when(F.col("result") == "W", 1)) / F.count("*")).alias("rate"), F.max("day").alias("last"))
    since = lambda d: F.col("last") >= F.lit(d).cast("date")
    key = F.col("rate") * F.least(F.lit(1.0), F.col("n") / 12) * F.when(since("2001-01-01"), 1.0).when(since("2000-01-01"), 0.7).otherwise(0.4)
    return r.withColumn("key", key).orderBy(F.desc(F.round("key", 9)), "entity").limit(25).select("entity", F.round("key", 6).alias("key"))


@query(CONTEST + """
, d AS (SELECT DISTINCT ON (entity) entity, contest_id, day, purse FROM side ORDER BY entity, purse DESC, contest_id)
SELECT entity, contest_id, round(purse, 2) AS purse FROM d ORDER BY purse DESC, entity LIMIT 20""")
def q_distinct_then_rank(spark, sf):
    best = perspectives(spark, sf).groupBy("entity").agg(F.min(F.struct((-F.col("purse")).alias("p"), "contest_id")).alias("m")).select("entity", "m.contest_id", (-F.col("m.p")).alias("purse"))
    return best.orderBy(F.desc("purse"), "entity").limit(20).select("entity", "contest_id", F.round("purse", 2).alias("purse"))


@query("""
WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30)
SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM top) GROUP BY l_orderkey""")
def q_limit_parents_first(spark, sf):
    """The thirty parents are chosen before their children are read: a broadcast of thirty keys."""
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(F.broadcast(top), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


KINDS = ["purchase", "click", "view"]


@query(f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(list_position({KINDS}, event_type), 99), ts, event_id) AS INTEGER) AS place, event_id, event_type FROM events""")
def q_enum_order(spark, sf):
    """Kinds in their declared order, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy(F.when(at > 0, at).otherwise(99), "ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("place"), "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 220")
def q_random_sample(spark, sf):
    """220 rows in the order of a seeded hash: the same seed gives the same sample, whatever the partitions."""
    own = F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")))
    return table(spark, sf, "orders").orderBy(own, "o_orderkey").limit(220).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_custkey) AS INTEGER) AS place FROM customer")
def q_text_order(spark, sf):
    """Names in an order that does not tell case apart."""
    w = Window.partitionBy("c_nationkey").orderBy(F.collate("c_name", "UNICODE_CI"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_name", F.row_number().over(w).alias("place"))


HEADLINE = f"""
SELECT entity, CASE WHEN retired THEN allt ELSE coalesce(divisional, cur, allt) END AS headline, CASE WHEN retired OR (divisional IS NULL AND cur IS NULL) THEN 'all-time' WHEN divisional IS NULL THEN 'current' ELSE 'divisional' END AS kind FROM (
  SELECT e.entity, e.last < DATE '{AS_OF}' - INTERVAL 24 MONTH AS retired, CAST(d.score AS DOUBLE) AS divisional, CAST(c.score AS DOUBLE) AS cur, a.score AS allt
  FROM ({CONTEST} SELECT entity, max(day) AS last FROM side GROUP BY entity) e LEFT JOIN (SELECT entity, max(score) AS score FROM ({{d}}) GROUP BY entity) d USING (entity) LEFT JOIN ({{c}}) c USING (entity) LEFT JOIN ({{a}}) a USING (entity))
WHERE coalesce(divisional, cur, allt) IS NOT NULL"""


def headlines(spark, sf):
    from . import ratings

    last = perspectives(spark, sf).groupBy("entity").agg(F.max("day").alias("last"))
    best = ratings.q_score_divisional(spark, sf).groupBy("entity").agg(F.max("score").cast("double").alias("divisional"))
    now = ratings.q_score_current(spark, sf).select("entity", F.col("score").cast("double").alias("cur"))
    ever = ratings.q_score_all_time(spark, sf).select("entity", F.col("score").alias("allt"))
    d = last.join(best, "entity", "left").join(now, "entity", "left").join(ever, "entity", "left").where(F.coalesce("divisional", "cur", "allt").isNotNull())
    retired = F.col("last") < S.months_ago(F.lit(AS_OF).cast("date"), 24)
    kind = F.when(retired | (F.col("divisional").isNull() & F.col("cur").isNull()), "all-time").when(F.col("divisional").isNull(), "current").otherwise("divisional")
    return d.select("entity", F.when(retired, F.col("allt")).otherwise(F.coalesce("divisional", "cur", "allt")).alias("headline"), kind.alias("kind"))


def _headline_sql() -> str:
    return HEADLINE.format(d=SQL["q_score_divisional"], c=SQL["q_score_current"], a=SQL["q_score_all_time"])


from . import ratings as _ratings  # noqa: E402, F401


@query(_headline_sql())
def q_headline_score(spark, sf):
    """All-time for the retired; else the best division, the current score, the all-time one, whichever there is."""
    return headlines(spark, sf)


@query(f"SELECT entity, headline, kind FROM ({_headline_sql()}) WHERE headline IS NOT NULL ORDER BY headline DESC, entity LIMIT 5")
def q_home_top(spark, sf):
    return headlines(spark, sf).where("headline is not null").orderBy(F.desc("headline"), "entity").limit(5)
