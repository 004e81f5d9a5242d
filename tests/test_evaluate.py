"""Evaluation at any size: running sums, AUC, isotonic steps and permutation tests against plain ones."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from bracketry.operators import evaluate as E
from bracketry.operators.scan import sums_before


def test_sums_before(spark):
    """One group with nearly all rows is cut into ranges."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 20 + ["cold", None]), i, rnd.randrange(9)) for i in rnd.sample(range(10_000), 2000)]
    d = spark.createDataFrame(rows, "g string, i long, v long")
    got = sums_before(d, ["g"], ["i"], ["v"])
    now = {}
    want = {}
    for g, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[g, i] = now.get(g, 0)
        now[g] = want[g, i] + v
    assert {(r.g, r.i): r.before_v for r in got.collect()} == want
    assert sums_before(d.limit(0), ["g"], ["i"], ["v"]).count() == 0


def plain_auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.choice([rnd.random(), 0.5, 0.25]), rnd.randrange(2)) for _ in range(500)] + [("none", 0.3, 1)]
    got = dict(E.auc(spark.createDataFrame(rows, "g string, p double, y int"), "p", "y", "g").collect())
    for g in "ab":
        assert got[g] == pytest.approx(plain_auc([(p, y) for k, p, y in rows if k == g]), abs=1e-12)
    assert got["none"] is None


def plain_steps(rows):
    out = []
    for p in sorted({p for p, _ in rows}):
        block = [p, p, sum(y for q, y in rows if q == p), sum(q == p for q, _ in rows)]
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return sorted({(x, s / w) for lo, hi, s, w in out for x in (lo, hi)})


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "few", "late"])
def test_isotonic(spark, shape):
    rnd = random.Random(3)
    p = [rnd.random() for _ in range(600)]
    y = {"rising": lambda x: float(rnd.random() < x), "falling": lambda x: float(rnd.random() > x), "noise": lambda x: float(rnd.randrange(2)), "few": lambda x: float(x > 0.5), "late": lambda x: 1.0 if x < 0.01 else 0.0}[shape]
    rows = [(round(x, 1) if shape == "few" else x, y(x)) for x in p]
    got = sorted(map(tuple, E.isotonic(spark.createDataFrame([*rows, (None, 1.0), (0.5, None)], "p double, y double"), "p", "y").collect()))
    want = plain_steps(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-12)
    assert E.isotonic(spark.createDataFrame([], "p double, y double"), "p", "y").count() == 0


def test_shuffled_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000):
        for seed in range(5):
            assert sorted(E.shuffled(np.arange(n), n, seed).tolist()) == list(range(n))
    first = [int(E.shuffled(np.arange(5), 5, s)[0]) for s in range(4000)]
    assert max(abs(first.count(k) / 4000 - 0.2) for k in range(5)) < 0.03
    pairs = [tuple(E.shuffled(np.arange(4), 4, s).tolist()) for s in range(6000)]
    assert max(abs(pairs.count(o) / 6000 - 1 / 24) for o in itertools.permutations(range(4))) < 0.02


def ranks(v):
    return np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])


@pytest.mark.parametrize("ties", [False, True])
def test_permutation_of_small_groups_is_near_the_exact_one(spark, ties):
    x = {"a": [1.0, 4.0, 2.0, 8.0, 5.0], "b": [0.5, 3.0, 3.0, 9.0]}
    y = {"a": [2.0, 1.0, 3.0, 9.0, 1.0 if ties else 7.0], "b": [1.0, 0.0, 2.0, 2.0 if ties else 5.0]}
    rows = [(10 * (g == "b") + i, g, x[g][i], y[g][i]) for g in x for i in range(len(x[g]))]
    d = spark.createDataFrame([*rows, (99, "a", None, 1.0)], "k long, g string, x double, y double")
    got = E.permutation(d, "k", "g", "x", "y", 3000).first()
    n = len(rows)
    seen = sum(np.dot(x[g], y[g]) for g in x) / n
    every = [(np.dot(x["a"], np.array(y["a"])[list(s)]) + np.dot(x["b"], np.array(y["b"])[list(t)])) / n for s in itertools.permutations(range(5)) for t in itertools.permutations(range(4))]
    assert got.observed == pytest.approx(seen) and abs(got.p - np.mean(np.array(every) >= seen - 1e-12)) < 0.03
    rho = lambda a, b: float(np.corrcoef(ranks(a), ranks(b))[0, 1])
    got = E.permutation(d.where("g = 'a'"), "k", "g", "x", "y", 3000, spearman=True).first()
    every = [rho(x["a"], np.array(y["a"])[list(s)]) for s in itertools.permutations(range(5))]
    assert got.observed == pytest.approx(rho(x["a"], y["a"])) and abs(got.p - np.mean(np.abs(every) >= abs(got.observed) - 1e-9)) < 0.03


def test_average_ranks(spark):
    d = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), (None, 7.0), ("a", None)], "g string, v double")
    got = sorted(((r.g, r.v, r["rank"]) for r in E.average_ranks(d, "g", "v", "rank").collect()), key=str)
    assert got == sorted([("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), (None, 7.0, 1.0), ("a", None, None)], key=str)
