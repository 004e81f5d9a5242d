"""Greedy choice against one pick at a time."""

from __future__ import annotations

import random

import pytest

from bracketry.operators.choice import greedy_cover

ROWS = "i long, e long, w long"


def plain(rows, most):
    of, weight = {}, {}
    for i, e, w in rows:
        if i is not None and e is not None and w is not None and w > 0:
            of.setdefault(i, set()).add(e)
            weight[e] = max(w, weight.get(e, 0))
    out, covered = [], set()
    while len(out) < most and of:
        gain, i = min((-sum(weight[e] for e in s - covered), i) for i, s in of.items())
        if gain == 0:
            break
        out.append((i, -gain, len(out) + 1))
        covered |= of.pop(i)
    return out


def picks(spark, rows, most, few=0):
    return [tuple(r) for r in greedy_cover(spark.createDataFrame(rows, ROWS), "i", "e", most, "w", few).orderBy("rank").collect()]


@pytest.mark.parametrize(("seed", "most"), [(1, 100), (2, 5), (3, 1)])
def test_equals_one_pick_at_a_time(spark, seed, most):
    """Ties, repeats, nulls, weights of zero, several weights of an element, and an element that a third of all rows share."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(25), rnd.randrange(40), rnd.randrange(4)) for _ in range(120)] + [(i, 7, 1) for i in range(60)]
    rows += [*rows[:9], (None, 1, 1), (1, None, 1), (2, 3, None), (99, 98, -1)]
    for few in (0, 60, 10_000):
        assert picks(spark, rows, most, few) == plain(rows, most), few


def test_a_chain_of_items_that_wait(spark):
    """Each item waits for the one before it."""
    rows = [(i, 100 * i + j, 1) for i in range(8) for j in range(20 - 2 * i)] + [(i, 100 * (i + 1), 1) for i in range(7)]
    assert picks(spark, rows, 20) == plain(rows, 20)


def test_without_rows(spark):
    assert picks(spark, [], 3) == picks(spark, [], 3, 10) == []
    with pytest.raises(ValueError, match="most"):
        picks(spark, [], 0)


def test_without_weights_and_by_name(spark):
    d = spark.createDataFrame([("b", 1), ("b", 1), ("b", 2), ("a", 2), ("a", 3), ("c", 3)], "i string, e int")
    assert [tuple(r) for r in greedy_cover(d, "i", "e", 9).orderBy("rank").collect()] == [("a", 2, 1), ("b", 1, 2)]
