"""Cuts, alignments and directions against brute force and numpy."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from bracketry.operators import cuts

LINKS = "a long, b long, w double"


def brute(nodes, edges):
    return max(sum(w for a, b, w in edges if s[a] != s[b]) for bits in itertools.product((0, 1), repeat=len(nodes) - 1) for s in [dict(zip(nodes, (0, *bits), strict=True))])


def value(edges, labels):
    return sum(w for a, b, w in edges if labels[a] != labels[b])


def test_small_graphs(spark):
    """Trees, even and odd rings, planted sides and weights, all in one run; no single flip adds to a cut."""
    rnd = random.Random(7)
    graphs = [[(i, i + 1, 1.0) for i in range(9)], [(i, (i + 1) % 8, 1.0) for i in range(8)], [(i, (i + 1) % 7, float(i + 1)) for i in range(7)], [(0, i, 2.0) for i in range(1, 9)]]
    for _ in range(6):
        side = [rnd.randrange(2) for _ in range(9)]
        graphs.append([(i, j, float(rnd.randrange(1, 5)) * (6 if side[i] != side[j] else 1)) for i in range(9) for j in range(i) if rnd.random() < 0.5 or j == i - 1])
    rows = [(100 * k + a, 100 * k + b, w) for k, g in enumerate(graphs) for a, b, w in g]
    d = spark.createDataFrame([*rows, (None, 1, 1.0), (5, 5, 9.0), (0, 1, 0.0)], LINKS)
    edges = cuts.conflicts(d, "a", "b", "w")
    out = cuts.max_cut(edges).collect()
    labels = {r.node: r.label for r in out}
    assert all(labels[r.component] == 0 and r.component == 100 * (r.node // 100) for r in out)
    for k, g in enumerate(graphs):
        own = {n - 100 * k: v for n, v in labels.items() if n // 100 == k}
        got, best = value(g, own), brute(sorted(own), g)
        assert all(value(g, own | {n: 1 - own[n]}) <= got + 1e-9 for n in own)
        assert got == best, (k, got, best)
    told = {r.component: r for r in cuts.frustration(edges, spark.createDataFrame(out)).collect()}
    assert told[0].frustration == 0 and told[200].within == 1.0 and told[200].nodes == 7


def test_flips_never_let_the_cut_fall(spark):
    """Without any turns of the power iteration the start is as good as chance."""
    rnd = random.Random(3)
    g = [(i, j, float(rnd.randrange(1, 9))) for i in range(30) for j in range(i) if rnd.random() < 0.2 or j == i - 1]
    edges = cuts.conflicts(spark.createDataFrame(g, LINKS), "a", "b", "w")
    cut = lambda n: value(g, {r.node: r.label for r in cuts.max_cut(edges, n).collect()})
    assert cut(0) >= sum(w for *_, w in g) / 2 and cut(24) >= sum(w for *_, w in g) / 2
    assert cuts.max_cut(cuts.conflicts(spark.createDataFrame([], LINKS), "a", "b", "w")).count() == 0


def test_small_components_are_cut_in_tasks_as_by_rounds(spark, monkeypatch):
    """Same labels both ways; without a large component no round of the cut is a table."""
    rnd = random.Random(11)
    g = [(40 * k + i, 40 * k + j, float(rnd.randrange(1, 9))) for k, n in enumerate((2, 3, 5, 12, 25)) for i in range(n) for j in range(i) if rnd.random() < 0.3 or j == i - 1]
    edges = cuts.conflicts(spark.createDataFrame(g, LINKS), "a", "b", "w")
    made = []
    monkeypatch.setattr(cuts, "stored", lambda df, own=cuts.stored: made.append(1) or own(df))
    whole = {tuple(r) for r in cuts.max_cut(edges).collect()}
    assert len(made) <= 4 and len(whole) == 47
    monkeypatch.setattr(cuts, "WHOLE", 60)
    assert {tuple(r) for r in cuts.max_cut(edges).collect()} == whole


def test_alignment_is_the_best_of_all_orientations(spark):
    rnd = np.random.default_rng(1)
    labels, signs, vectors = [], {}, {}
    for term in (1, 2):
        for comp, n in ((10, 6), (20, 4), (30, 3), (40, 2)):
            for i in range(n):
                node = term * 1000 + comp + i
                label = i % 2 if n > 2 else 0
                labels.append((term, node, term * 1000 + comp, label))
                vectors[node] = (rnd.normal(0, 0.2, 3) + (1 if label else -1) * np.array([1, -1, 0.5]) * rnd.choice([1, -1]) if comp == 30 else rnd.normal(0, 1, 3)).tolist()
    d = spark.createDataFrame(labels, "term int, node long, component long, label int")
    s = spark.createDataFrame(list(vectors.items()), "node long, vector array<double>")
    got = {r.node: r.label for r in cuts.align(d, s, ["term"]).collect()}
    assert len(got) == len(labels)
    for term in (1, 2):
        mean = lambda c, k, term=term: np.mean([vectors[n] for t, n, x, lab in labels if (t, x, lab) == (term, term * 1000 + c, k)], axis=0)
        for c in (20, 30):
            best = max((0, 1), key=lambda turn: sum(mean(c, k) @ mean(10, k ^ turn) for k in (0, 1)))
            assert all(got[n] == lab ^ best for t, n, x, lab in labels if x == term * 1000 + c)
        assert all(got[n] == lab for t, n, x, lab in labels if t == term and x % 1000 in (10, 40))


def test_direction_and_median(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for g, n in (("a", 400), (None, 61), ("few", 5)):
        axis = rnd.normal(0, 1, 6)
        for i in range(n):
            x, t = rnd.normal(0, 1, 6), rnd.choice([-1, 1]) * 3
            rows += [(g, i, (x + t * axis).tolist()), (g, i, (x - t * axis).tolist())]
    rows.append(("a", 9999, None))
    d = spark.createDataFrame(rows, "g string, f long, v array<double>").withColumn("i", F.monotonically_increasing_id())
    d = d.withColumn("g", F.coalesce("g", F.lit("null")))
    pairs = d.groupBy("g", "f").agg(F.min_by("v", "i").alias("p"), F.max_by("v", "i").alias("q"))
    dirs = cuts.leading_direction(pairs, "p", "q", ["g"])
    got = {r.g: np.array(r.direction) for r in dirs.collect()}
    assert set(got) == {"a", "null"}
    report = {r.g: r for r in cuts.sides_report(cuts.two_sides(d.where("v is not null"), "v", ["g"], dirs), ["g"], "f").collect()}
    for g in got:
        x = np.array([r[2] for r in rows if (r[0] or "null") == g and r[2]])
        diff = x[::2] - x[1::2]
        w = np.linalg.eigh(diff.T @ diff)[1][:, -1]
        assert abs(abs(w @ got[g]) - 1) < 1e-9 and got[g][np.argmax(np.abs(got[g]))] > 0
        proj = x @ got[g]
        label = proj > np.median(proj)
        assert abs(report[g].disagreement - (label[::2] != label[1::2]).mean()) < 1e-12 and report[g].usable
        assert abs(report[g].separation - abs(proj[label].mean() - proj[~label].mean())) < 1e-9


def test_exact_medians(spark):
    rnd = random.Random(5)
    rows = [("odd", float(i)) for i in range(4001)] + [("even", rnd.gauss(0, 1)) for _ in range(3000)] + [("ties", float(i % 3)) for i in range(1000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("two", None)]
    got = dict(cuts.medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect())
    for g in {r[0] for r in rows}:
        assert abs(got[g] - np.median([x for k, x in rows if k == g and x is not None])) < 1e-12, g
