"""Operators on hand-made rows: nulls, ties, empty tables and properties that must hold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bracketry.functions import odds as O
from bracketry.functions import scalar as S
from bracketry.functions import text as T
from bracketry.operators import asof, evaluate, graph, history, merge, replay, twosided


def values(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def day(n: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_rounding(spark):
    halves = [F.lit(x) for x in (2.5, -2.5, 0.125)]
    assert values(spark, *map(S.round_half_up, halves[:2]), S.round_half_up(halves[2], 2)) == (3.0, -3.0, 0.13)
    assert values(spark, *map(S.round_half_even, halves[:2])) == (2.0, -2.0)
    assert values(spark, *map(S.round_toward_plus, halves[:2])) == (3, -2)


def test_curves(spark):
    at = lambda f, *xs: [round(v, 6) for v in values(spark, *[f(F.lit(float(x))) for x in xs])]
    assert at(S.decay, 0, 1, 2, 3, 4, 5, 9) == [1, 1, 0.65, 0.3, 0.2, 0.1, 0.1]
    assert at(S.score_curve, -1, 0, 25, 45, 60, 75, 88, 99) == [0, 0, 25, 60, 80, 93, 100, 100]
    assert at(S.layoff_penalty, 3, 12, 20, 90) == [0, 0, 4, 15]
    assert values(spark, S.age_factor(F.lit(None)), S.age_factor(F.lit(25)), S.age_factor(F.lit(40))) == (0.0, 0.0, -0.12)
    assert values(spark, S.safe_ratio(F.lit(1), F.lit(0)), S.safe_ratio(F.lit(1), F.lit(0), 7.0)) == (None, 7.0)
    assert values(spark, S.clamp(F.lit(None).cast("double"), 0, 1), S.clamp(F.lit(4.0), 0, 1)) == (0.0, 1.0)  # least and greatest skip nulls


def test_prices(spark):
    assert values(spark, *[O.american_to_decimal(F.lit(v)) for v in (100, 250, -100, -400, 50)]) == (2.0, 3.5, 2.0, 1.25, None)
    assert values(spark, O.devig(F.lit(2.0), F.lit(2.0)), O.devig(F.lit(1.0), F.lit(2.0))) == (0.5, None)
    assert values(spark, O.devig_many(F.array(F.lit(1.9), F.lit(1.0)))) == (None,)
    p = values(spark, O.margin_prices(F.array(F.lit(0.7), F.lit(0.3)), 0.05))[0]
    assert abs(sum(1 / x for x in p) - 1.05) < 0.01
    assert values(spark, O.margin_prices(F.array(F.lit(0.0), F.lit(0.0)), 0.05))[0] == [25.0, 25.0]
    assert values(spark, O.reconcile(F.array(*[F.lit(0.0)] * 3), F.lit(0.6)))[0] == pytest.approx([0.2] * 3)
    q = F.array(F.lit(900.0), F.lit(0.0))
    assert sum(values(spark, O.lmsr_prices(q, 1.0))[0]) == pytest.approx(1)
    assert values(spark, O.lmsr_cost(q, 1.0))[0] == pytest.approx(900)
    won, lost = F.lit(True), F.lit(False)
    none = F.lit(None).cast("boolean")
    assert values(spark, O.grade(F.lit("a"), won, lost, won), O.grade(F.lit("b"), won, lost, won), O.grade(F.lit("a"), none, lost, won), O.grade(F.lit("finish"), none, won, won), O.grade(F.lit("a"), won, won, lost)) == ("won", "lost", "void", "won", "open")


def test_names_and_units(spark):
    same = lambda a, b: T.names_compatible(F.lit(a), F.lit(b))
    assert values(spark, same("José Silva", "Jose Silva"), same("J Silva", "Jose Silva"), same("Ana Silva", "Jose Silva"), same("Silva", "Jose Silva")) == (True, True, False, True)
    assert values(spark, T.clock_seconds(F.lit("4:59")), T.clock_seconds(F.lit("4:75")), T.feet_inches_cm(F.lit("5' 11\"")), T.slug(F.lit("Ünder  the-Sea!"))) == (299, None, 180, "under-the-sea")
    assert values(spark, *[T.any_date(F.lit(x)) for x in ("2021-12-11", "Dec 11, 2021", "December 11th, 2021", "", "soon", "0001-01-01")]) == (dt.date(2021, 12, 11),) * 3 + (None,) * 3
    assert values(spark, T.trigram_similarity(F.lit(""), F.lit("")), T.trigram_similarity(F.lit("word"), F.lit("word"))) == (0.0, 1.0)


@pytest.mark.parametrize(("strict", "limit"), [(True, None), (False, None), (True, 5), (False, 5)])
def test_as_of(spark, strict, limit):
    r = random.Random(7)
    left = [(i, r.choice("abc"), day(r.randrange(40))) for i in range(60)] + [(99, None, day(3))]
    right = list({(k, day(r.randrange(40))): None for k in "abd" for _ in range(12)})
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    got = asof.as_of(spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, at date, v double"), "k", "t", "at", ["v"], strict, limit)
    want = {}
    for i, k, t in left:
        best = max(((d, v) for x, d, v in right if x == k and (d < t if strict else d <= t)), default=None)
        want[i] = best[1] if best and (limit is None or (t - best[0]).days <= limit) else None
    assert {x.i: x.v for x in got.collect()} == want


def test_contained(spark):
    r = random.Random(2)
    spans = [(i, r.choice("xy"), day(a := r.randrange(900)), None if i % 5 == 0 else day(a + r.randrange(400))) for i in range(25)]
    rows = [(i, r.choice("xyz"), day(r.randrange(1300))) for i in range(80)]
    got = asof.contained(spark.createDataFrame(rows, "id int, k string, t date"), spark.createDataFrame(spans, "span int, k string, a date, b date"), "t", "a", "b", ["k"], width_days=100)
    assert {(x.id, x.span) for x in got.collect()} == {(i, s) for i, k, t in rows for s, q, a, b in spans if k == q and a <= t and (b is None or t <= b)}


def contests(spark):
    rows = [(1, "a", "b", day(1), "a"), (2, "b", "a", day(2), None), (3, "a", "c", day(2), "a"), (4, "a", "b", day(9), "b")]
    return spark.createDataFrame(rows, "id int, a_id string, b_id string, day date, winner_id string")


def test_sides(spark):
    got = {(x.id, x.entity): (x.opponent, x.result) for x in twosided.sides(contests(spark)).collect()}
    assert got[2, "b"] == ("a", "D") and got[4, "a"] == ("b", "L") and got[4, "b"] == ("a", "W") and len(got) == 8


def test_swapping_twice_changes_nothing(spark):
    d = spark.createDataFrame([(1, 3, 4, 0.2), (2, 5, None, 0.9)], "id int, x_a int, x_b int, p double")
    once = twosided.swapped(d, complements=("p",))
    assert [tuple(x) for x in once.orderBy("id").collect()] == [(1, 4, 3, 0.8), (2, None, 5, pytest.approx(0.1))]
    assert [(x.x_a, x.x_b) for x in twosided.swapped(once, complements=("p",)).orderBy("id").collect()] == [(3, 4), (5, None)]


def test_what_comes_later_changes_nothing_before(spark):
    s = twosided.sides(contests(spark))
    pre = lambda d: {(x.id, x.entity): x.n for x in d.withColumn("n", F.count("*").over(history.before("entity", "day", "id"))).collect()}
    early = pre(s.where(F.col("day") <= day(2)))
    assert {k: v for k, v in pre(s).items() if k in early} == early


def test_streaks_and_runs(spark):
    rows = [("a", i, x) for i, x in enumerate("WWLLLW")] + [("b", 1, "W"), ("b", 2, "W")]
    d = spark.createDataFrame(rows, "k string, i int, r string")
    assert {(x.k, x.r, x.n) for x in history.current_streaks(d, "k", ["i"], "r").collect()} == {("a", "W", 1), ("b", "W", 2)}
    days = spark.createDataFrame([("u", day(n)) for n in (1, 2, 3, 3, 4, 6, 8, 9)], "k string, d date")
    assert [tuple(x) for x in history.day_runs(days, "k", "d").collect()] == [("u", 4)]
    ticks = spark.createDataFrame([("u", i, v) for i, v in enumerate([None, None, 1, 1, 2, 1, None])], "k string, i int, v int")
    assert sorted(x.i for x in history.changes_only(ticks, ["k"], ["i"], "v").collect()) == [0, 2, 4, 5, 6]
    assert history.best_window(d, "k", ["i"], F.when(F.col("r") == "W", 60).otherwise(0), 3).collect() == [("a", 100.0)]


def test_merging_a_batch_twice_is_merging_it_once(spark):
    t = spark.createDataFrame([(1, "scheduled", 5, None), (2, "completed", 7, "x"), (None, "scheduled", 1, "n")], "id int, status string, seen int, note string")
    b = spark.createDataFrame([(1, "completed", 9, "new"), (2, "scheduled", 3, None), (4, "scheduled", 4, "y"), (None, "scheduled", 0, "m")], "id int, status string, seen int, note string")
    rules = {"status": merge.no_demotion("completed"), "seen": merge.smaller, "note": merge.fill_new}
    one = merge.upsert(t, b, ["id"], rules)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(one) == sorted([(1, "completed", 5, "new"), (2, "completed", 3, "x"), (4, "scheduled", 4, "y"), (None, "scheduled", 0, "m")], key=str)
    assert rows(merge.upsert(one, b, ["id"], rules)) == rows(one)
    kept, gone = merge.retire_missing(t, b.where("false"), ["id"])
    assert (kept.count(), gone.count()) == (3, 0)  # an empty list deletes nothing


def test_labels_reach_as_far_as_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)]
    got = dict(graph.smallest_reachable(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    seeds = spark.createDataFrame([(0, "m")], "node long, label string")
    far = [(i, i + 1) for i in range(50)] + [(None, 3), (7, 7), (200, 201)]
    got = dict(graph.spread(seeds, spark.createDataFrame(far, "a long, b long"), "a", "b").collect())
    assert got == dict.fromkeys(range(51), "m")
    votes = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (9, 10), (1, 11), (3, 11)], "a long, b long")
    some = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, "c"), (5, None)], "node long, label string")
    assert {k: v for k, v in graph.spread(some, votes, "a", "b").collect() if k > 8} == {9: "b", 10: "b", 11: "a"}


def plain_elo(rows):
    now, out = {}, {}
    for contest, _, a, b, won in rows:
        x, y = now.get(a, 1500.0), now.get(b, 1500.0)
        gain = 0.0 if won is None else 32 * (won - 1 / (1 + 10 ** ((y - x) / 400)))
        now[a], now[b] = x + gain, y - gain
        out[contest, a], out[contest, b] = (x, x + gain), (y, y - gain)
    return out


def replay_rows(n=120, entities=9):
    r = random.Random(3)
    rows = []
    for k in range(n):
        a, b = r.sample(range(entities), 2) if k % 3 else (0, r.randrange(1, entities))  # one entity is in every third
        rows.append((k, k // 7, a, b, r.choice([0, 1, 1, None])))
    return rows


REPLAYED = "contest_id int, day int, a_id int, b_id int, won int"


@pytest.mark.parametrize(("n", "few"), [(120, 1000), (40, 8), (0, 10)])
def test_elo_against_a_plain_replay(spark, monkeypatch, n, few):
    monkeypatch.setattr(replay, "FEW", few)
    rows = replay_rows(n)
    got = replay.by_side(replay.elo(spark.createDataFrame(rows, REPLAYED), ["day", "contest_id"]), ["rating"]).collect()
    assert len(got) == 2 * len(rows)
    assert {(x.contest_id, x.entity): (x.rating, x.rating_after) for x in got} == {k: pytest.approx(v) for k, v in plain_elo(rows).items()}


def test_glicko_against_a_plain_replay(spark, monkeypatch):
    monkeypatch.setattr(replay, "FEW", 20)
    rows, now, want = replay_rows(30), {}, {}
    for contest, _, a, b, won in rows:
        x, y = now.get(a, (1500.0, 350.0, 0.06)), now.get(b, (1500.0, 350.0, 0.06))
        score = 0.5 if won is None else won
        now[a], now[b] = replay.glicko_move(*x, *y[:2], score), replay.glicko_move(*y, *x[:2], 1 - score)
        want[contest] = (*now[a][:2], *now[b][:2])
    got = replay.glicko(spark.createDataFrame(rows, REPLAYED), ["day", "contest_id"]).collect()
    assert {x.contest_id: (x.a_rating_after, x.a_rd_after, x.b_rating_after, x.b_rd_after) for x in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_known_glicko_move():
    # a strong win against a weaker player of known deviation raises the rating and narrows the deviation
    rating, rd, vol = replay.glicko_move(1500.0, 200.0, 0.06, 1400.0, 30.0, 1.0)
    assert rating == pytest.approx(1563.56, abs=0.1) and rd == pytest.approx(175.4, abs=0.1) and vol == pytest.approx(0.06, abs=1e-4)


def test_attack_and_defence_against_a_plain_replay(spark):
    r = random.Random(5)
    rows = [(*x[:4], float(r.randrange(6)), float(r.randrange(6))) for x in replay_rows(60)]
    league, total, n, now, want = {}, 0.0, 0, {}, {}
    for day in sorted({x[1] for x in rows}):
        league[day] = (200 * 2.5 + total) / (200 + n)
        total += sum(x[4] + x[5] for x in rows if x[1] == day)
        n += sum(2 for x in rows if x[1] == day)
    for contest, day, a, b, sa, sb in rows:
        (oa, da), (ob, db) = now.get(a, (0.0, 0.0)), now.get(b, (0.0, 0.0))
        ea, eb = sa - (league[day] + oa + db), sb - (league[day] + ob + da)
        now[a], now[b] = (oa + 0.2 * ea, da + 0.2 * eb), (ob + 0.2 * eb, db + 0.2 * ea)
        want[contest] = (*now[a], *now[b])
    c = spark.createDataFrame(rows, "contest_id int, day int, a_id int, b_id int, a_score double, b_score double")
    means = replay.league_mean(c, "day", [c.a_score, c.b_score], 2.5)
    got = replay.attack_defence(c.join(means, "day"), ["day", "contest_id"]).collect()
    assert {x.contest_id: (x.a_attack_after, x.a_defence_after, x.b_attack_after, x.b_defence_after) for x in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_evaluation(spark):
    r = random.Random(3)
    rows = [(i, i % 3, round(r.random(), 1), int(r.random() < 0.5)) for i in range(120)]
    d = spark.createDataFrame(rows, "id int, g int, p double, y int")
    for g, a in evaluate.auc(d, "p", "y", "g").collect():
        pos, neg = ([p for _, q, p, y in rows if q == g and y == v] for v in (1, 0))
        assert a == pytest.approx(sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / (len(pos) * len(neg)))
    m = evaluate.murphy(d.withColumn("p", F.floor(F.col("p") * 10) / 10 + 0.05), "p", "y").first()
    brier = evaluate.scores(d.withColumn("p", F.floor(F.col("p") * 10) / 10 + 0.05), "p", "y").first().brier
    assert m.reliability - m.resolution + m.uncertainty == pytest.approx(brier, abs=0.02)
    one = evaluate.bootstrap(d, "id", "p", 100).first()
    assert one.lo < sum(x[2] for x in rows) / len(rows) < one.hi
    same = d.withColumn("x", F.col("y").cast("double"))
    assert evaluate.permutation(same, "id", "g", "x", "y", 60).first().p == pytest.approx(1 / 61)
    steps = evaluate.isotonic(spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0)], "p double, y double"), "p", "y").collect()
    assert [x.value for x in steps] == sorted(x.value for x in steps) and dict(map(tuple, steps))[0.3] == 0.5
    fit = evaluate.ridge(spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(9)], "x double, y double"), "y", ["x"], 0.0)
    assert fit == {"1": pytest.approx(1), "x": pytest.approx(2)}


def test_similar_sets_against_all_pairs(spark):
    from bracketry.operators import fuzzy

    r = random.Random(9)
    base = [{r.randrange(40) for _ in range(r.choice([3, 8, 20]))} for _ in range(25)]
    sets = base + [s - set(r.sample(sorted(s), 1)) | {r.randrange(40)} for s in base for _ in range(3)]
    rows = [(i, sorted(s)) for i, s in enumerate(sets)] + [(900, []), (901, [])]
    got = fuzzy.similar(spark.createDataFrame(rows, "k long, g array<int>"), "k", F.col("g"), 0.7).collect()
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) / len(a | b) > 0.7}
    assert len(want) > 20 and {(x.a, x.b): x.similarity for x in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_best_and_only_candidates(spark):
    from bracketry.operators import fuzzy

    d = spark.createDataFrame([(1, 0.5, "a"), (1, 0.9, "b"), (2, 0.4, "c"), (3, 0.7, "e"), (3, 0.7, "d")], "k int, s double, c string")
    assert sorted(x.c for x in fuzzy.best(d, "k", [F.desc("s"), F.col("c")]).collect()) == ["b", "c", "d"]
    assert [x.c for x in fuzzy.only(d, "k").collect()] == ["c"]
    near = fuzzy.near_days(spark.sql("select date '2000-01-03' as x"), spark.sql("select explode(sequence(date '2000-01-01', date '2000-01-09')) as y"), "x", "y", 2)
    assert near.count() == 5


def test_replay_by_slabs_and_parts(spark, monkeypatch):
    """Slabs of several parts give the plain replay, and tables are as many as slabs, not as the longest chain of contests."""
    monkeypatch.setattr(replay, "FEW", 10)
    made = []
    monkeypatch.setattr(replay, "stored", lambda df, own=replay.stored: made.append(1) or own(df))
    r = random.Random(8)
    rows = [(k, k // 7, *([0, k % 50 + 1] if k % 2 else r.sample(range(100), 2)), r.choice([0, 1, None])) for k in range(120)]
    got = replay.by_side(replay.elo(spark.createDataFrame(rows, REPLAYED), ["day", "contest_id"]), ["rating"]).collect()
    assert {(x.contest_id, x.entity): (x.rating, x.rating_after) for x in got} == {k: pytest.approx(v) for k, v in plain_elo([x for x in rows if x[2] != x[3]]).items()}
    assert len(made) <= 4


def test_parts_of_a_slab_share_no_entity():
    r = random.Random(2)
    import numpy as np

    a, b = (np.array([r.randrange(400) for _ in range(150)]) for _ in range(2))
    part = replay._apart(a, b, 4)
    at = {}
    for x, y, p in zip(a.tolist(), b.tolist(), part.tolist(), strict=True):
        assert at.setdefault(x, p) == p and at.setdefault(y, p) == p
    assert set(part.tolist()) == {0, 1, 2, 3}
