"""Regressions against plain numpy fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracketry.operators import regression as R


def plain_glm(family, x, y, w, o, penalty, intercept=True):
    d = np.hstack([np.ones((len(y), 1)), x]) if intercept else x
    fined = np.full(d.shape[1], penalty)
    if intercept:
        fined[0] = 0
    b = np.zeros(d.shape[1])
    if intercept and family == "poisson":
        b[0] = np.log((w * y).sum() / (w * np.exp(o)).sum())
    for _ in range(60):
        eta = d @ b + o
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        v = w * (mu if family == "poisson" else mu * (1 - mu))
        b = b + np.linalg.solve((d * v[:, None]).T @ d + np.diag(fined), d.T @ (w * (y - mu)) - fined * b)
    return b


def made(seed, n, family):
    rnd = np.random.default_rng(seed)
    x = np.column_stack([rnd.normal(2, 3, n), rnd.integers(0, 2, n), rnd.integers(0, 4, n) / 4])
    o, w = rnd.normal(0, 0.5, n), rnd.integers(1, 4, n).astype(float)
    eta = -0.7 + x @ [0.2, -0.8, 0.5] + o
    y = rnd.poisson(np.exp(eta)) if family == "poisson" else (rnd.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return x, y.astype(float), w, o


@pytest.mark.parametrize("family", ["poisson", "logit"])
@pytest.mark.parametrize("pool", [False, True])
def test_like_numpy(spark, family, pool):
    """Groups of unlike size, one of them null and one with most rows; offset, weights, penalty, with and without an intercept."""
    rows, want = [], {}
    for g, n in (("a", 3000), ("b", 300), (None, 400)):
        x, y, w, o = made(n, n, family)
        want[g] = (x, y, w, o)
        rows += [(g, *map(float, r), float(b), float(c), float(d)) for r, b, c, d in zip(x, y, w, o, strict=True)]
    d = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double, w double, o double")
    nothing = spark.createDataFrame([("a", None, 1.0, 1.0, 1.0, 1.0, 0.0), ("a", 9.0, 1.0, 1.0, 99.0, 0.0, 0.0)], d.schema)
    for penalty, intercept in ((0.0, True), (5.0, True), (0.5, False)):
        fit = R.fit_glm(d.unionAll(nothing), family, "y", ["x1", "x2", "x3"], ["g"], "w", "o", penalty, intercept, pool).collect()
        assert {r.g for r in fit} == set(want) and all(r.status == "ok" for r in fit)
        for r in fit:
            assert np.abs(np.array(r.coefs) - plain_glm(family, *want[r.g], penalty, intercept)).max() < 1e-6
            assert r.terms == ["intercept"] * intercept + ["x1", "x2", "x3"]
    whole = R.fit_glm(d, family, "y", ["x1", "x2", "x3"], weight="w", offset="o", pool=pool).first()
    both = [np.concatenate([want[g][i] for g in want]) for i in range(4)]
    assert np.abs(np.array(whole.coefs) - plain_glm(family, *both, 0.0)).max() < 1e-6


def test_penalty_by_group_and_means(spark):
    x, y, w, o = made(7, 500, "logit")
    rows = [(c, *map(float, r), float(b)) for c in (0.1, 10.0) for r, b in zip(x, y, strict=True)]
    d = spark.createDataFrame(rows, "c double, x1 double, x2 double, x3 double, y double")
    fit = R.fit_glm(d, "logit", "y", ["x1", "x2", "x3"], ["c"], penalty="c", intercept=False)
    got = {r.c: np.array(r.coefs) for r in fit.collect()}
    for c in got:
        assert np.abs(got[c] - plain_glm("logit", x, y, np.ones(500), np.zeros(500), c, False)).max() < 1e-6
    p = R.with_mean(d.where("c = 10"), fit, "logit", ["x1", "x2", "x3"], ["c"], intercept=False).select("x1", "x2", "x3", "mean").collect()
    assert all(abs(r["mean"] - 1 / (1 + np.exp(-np.dot(got[10.0], r[:3])))) < 1e-12 for r in p) and len(p) == 500
    assert R.coefficients(fit, ["c"]).where("term = 'x2'").count() == 2


def test_separable_and_odd_data(spark):
    rows = [("parted", float(i), 0.0, float(i > 5)) for i in range(12)]
    rows += [("nearly", float(i), 0.0, float(i > 5)) for i in range(12)] + [("nearly", 5.5, 0.0, v) for v in (0.0, 1.0)]
    rows += [("ones", float(i), 0.0, 1.0) for i in range(5)] + [("flat", 3.0, 1.0, float(i % 3 == 0)) for i in range(9)]
    rows += [("same", float(i % 3), float(i % 3), float(i % 2)) for i in range(30)]
    d = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    fit = {r.g: r for r in R.fit_glm(d, "logit", "y", ["x1", "x2"], ["g"]).collect()}
    assert {g: r.status for g, r in fit.items()} == {"parted": "separated", "nearly": "separated", "ones": "separated", "flat": "ok", "same": "ok"}
    assert fit["parted"].coefs is None and abs(fit["same"].coefs[1] - fit["same"].coefs[2]) < 1e-9
    p = {r.g: r["mean"] for r in R.with_mean(d, R.fit_glm(d, "logit", "y", ["x1", "x2"], ["g"]), "logit", ["x1", "x2"], ["g"]).groupBy("g").agg(F.sum("mean").alias("mean")).collect()}
    assert abs(p["flat"] - 3) < 1e-6 and p["ones"] is None
    fined = R.fit_glm(d, "logit", "y", ["x1", "x2"], ["g"], penalty=1.0).collect()
    assert all(r.status == "ok" for r in fined if r.g != "ones")
    none = R.fit_glm(d.withColumn("y", F.lit(0.0)), "poisson", "y", ["x1"], ["g"]).collect()
    assert all(r.status == "separated" for r in none)
    assert R.fit_glm(d.limit(0), "logit", "y", ["x1"]).count() == 0 and R.fit_glm(d.limit(0), "poisson", "y", ["x1"], ["g"]).count() == 0


def test_a_step_too_far_is_halved(spark):
    """A plain Newton step from the start overshoots here."""
    rows = [(0.0, 0.0)] * 30 + [(1.0, 500.0), (10.0, 1.0)]
    d = spark.createDataFrame(rows, "x double, y double")
    r = R.fit_glm(d, "poisson", "y", ["x"], penalty=1e-3).first()
    b, mu = np.array(r.coefs), None
    x, y = np.array(rows).T
    mu = np.exp(b[0] + b[1] * x)
    assert r.status == "ok" and abs((y - mu).sum()) < 1e-6 and abs((x * (y - mu)).sum() - 1e-3 * b[1]) < 1e-6


def test_signs(spark):
    """The conditions of an optimum: no gain along free coefficients, none inwards at a bound."""
    rnd = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 400), (None, 60)):
        x = rnd.normal(0, 1, (n, 4)) * [1, 5, 0.1, 1] + [0, 1e6, 0, 3]
        x[:, 3] = x[:, 0] + 0.05 * rnd.normal(0, 1, n)
        y = 10 + x[:, 0] * 2 - x[:, 1] * 0.3 + x[:, 2] + rnd.normal(0, 1, n)
        rows += [(g, *map(float, r), float(v), 7.0) for r, v in zip(x, y, strict=True)]
    d = spark.createDataFrame(rows, "g string, a double, b double, c double, e double, y double, flat double")
    names = ["a", "b", "c", "e", "flat"]
    signs = {"a": -1, "b": 1, "c": 1, "flat": 1}
    for r in R.fit_ridge(d, "y", names, ["g"], 0.7, signs).collect():
        data = np.array([row[1:] for row in rows if row[0] == r.g])
        x, y = data[:, [0, 1, 2, 3, 5]], data[:, 4]
        sd = x.std(axis=0)
        sd[sd == 0] = 1
        z, t, b = (x - x.mean(axis=0)) / sd, y - y.mean(), np.array(r.coefs[1:]) * sd
        slope = z.T @ (z @ b - t) + 0.7 * b
        for j, f in enumerate(names):
            s = signs.get(f, 0)
            assert s * b[j] >= 0 and (abs(slope[j]) < 1e-5 or (s and b[j] == 0 and s * slope[j] > 0)), (r.g, f)
        assert abs(r.r2 - (1 - ((t - z @ b) ** 2).sum() / (t**2).sum())) < 1e-9 and abs(sum(r.shares) - 1) < 1e-12
    free = R.fit_ridge(d, "y", names, penalty=0.7).first()
    data = np.array([row[1:] for row in rows])
    x, y = data[:, :4], data[:, 4]
    z, t = (x - x.mean(axis=0)) / x.std(axis=0), y - y.mean()
    assert np.abs(np.array(free.coefs[1:5]) * x.std(axis=0) - np.linalg.solve(z.T @ z + 0.7 * np.eye(4), z.T @ t)).max() < 1e-6
    assert R.fit_ridge(d.limit(0), "y", names).count() == 0
