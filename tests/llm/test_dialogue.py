"""Repair of conversations against a search of all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from bracketry.llm import op12
from bracketry.llm.dialogue import damage, repair

TURNS = "conv_id long, turn long, role string, text string"
DAMAGED = "conv long, turn long, role string, text string, alive boolean"
LEGAL = re.compile(r"(s?(ua)+)?")


def all_edits(rows):
    """(cost, audit, roles and texts) of every way to edit rows with at most two insertions in a place."""
    gap = [[("I", r) for r in c] for n in (0, 1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]

    def own(role, text, fault):
        late = 3 if fault == "truncated" else 0
        yield 4, "D", None
        if fault not in ("blank", "duplicate"):
            yield late, "K", (role, text)
            for r in ("user", "assistant"):
                yield 3 + late, "R", (r, text)

    for inserted in itertools.product(gap, repeat=len(rows) + 1):
        for chosen in itertools.product(*[list(own(*r)) for r in rows]):
            cost, audit, out = 0, "", []
            for k, ins in enumerate(inserted):
                cost, audit = cost + 3 * len(ins), audit + "I" * len(ins)
                out += [(r, "") for _, r in ins]
                if k < len(rows):
                    c, letter, left = chosen[k]
                    cost, audit = cost + c, audit + letter
                    out += [left] if left else []
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                yield cost, audit, tuple(out)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def test_cheapest_of_all_edits(spark):
    rnd = random.Random(5)
    convs = [[(rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["a.", "b", "c!", " ", "d? \n"])) for _ in range(rnd.choice([0, 1, 2, 3, 3]))] for _ in range(60)]
    rows = [(k, i, r, t, True) for k, c in enumerate(convs) for i, (r, t) in enumerate(c)]
    rows += [(k, 0, "user", "gone", False) for k, c in enumerate(convs) if not c]
    got = {r.conv: r for r in repair(spark.createDataFrame(rows, DAMAGED)).collect()}
    assert len(got) == len(convs)
    for k, c in enumerate(convs):
        best = min(all_edits(faults(c)))
        assert (got[k].cost, got[k].audit, tuple((t.role, t.text) for t in got[k].repaired)) == best, c
        assert len({x[2] for x in all_edits(faults(c)) if x[:2] == best[:2]}) == 1
        kinds = [f for _, _, f in faults(c)]
        assert [got[k].blank, got[k].duplicate, got[k].truncated] == [kinds.count(x) for x in ("blank", "duplicate", "truncated")]
        pairs = [(a[0][:1] + b[0][:1]) for a, b in itertools.pairwise(c)]
        assert got[k].illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(20)]
    out = damage(spark.createDataFrame(rows, TURNS)).collect()
    for c, t in itertools.product(range(20), range(20)):
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        mine = [(r.role, r.text, r.alive) for r in out if (r.conv, r.turn) == (c, t)]
        assert mine == [("user" if fate == 4 else "assistant", {1: "", 2: "One Two Three"}.get(fate, "One. Two! Three?"), fate != 0)] * (2 if fate == 3 else 1)


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, "user", "x."), (None, 3, None, "y."), (None, 3, "assistant", None), (1, 5, "user", "b."), (1, 5, "assistant", "a."), (1, 5, "assistant", "a."), (2, None, None, None)]
    d = spark.createDataFrame(rows, TURNS).withColumns({"turns": F.lit(1), "fault": F.lit(2), "at": F.lit(3), "alive": F.lit(False), "conv": F.lit(9)})
    fixed = repair(damage(d)).collect()
    assert {r.conv for r in fixed} == {None, 1, 2}
    for r in fixed:
        assert LEGAL.fullmatch("".join(t.role[:1] for t in r.repaired))
        assert r.gaps == 0
    assert repair(damage(d.limit(0))).count() == 0


def test_gaps_ignore_nulls(spark):
    rows = [(1, t, "user", "x.", True) for t in (None, 4, 4, 9)] + [(2, None, "user", "x.", True), (3, 1, "user", "x.", False)]
    assert {r.conv: r.gaps for r in repair(spark.createDataFrame(rows, DAMAGED)).collect()} == {1: 4, 2: 0, 3: 0}


def test_a_long_conversation(spark):
    """As many turns as a hundred times the longest in the tables: cost and audit of the plain recursion."""
    rnd = random.Random(1)
    c = [(rnd.choice(["user", "assistant"]), f"t{i}" + rnd.choice(".!x")) for i in range(3000)]
    r = repair(spark.createDataFrame([(1, i, a, t, True) for i, (a, t) in enumerate(c)], DAMAGED)).first()
    state = {0: (0, ""), 1: (10**9, ""), 2: (3, "I"), 3: (6, "II")}
    for role, text, fault in faults(c):
        late = 3 if fault == "truncated" else 0
        new = {s: (x[0] + 4, x[1] + "D") for s, x in state.items()}
        for s, x in state.items():
            to = 3 if s == 2 else 2
            kept = role[0] == ("a" if s == 2 else "u")
            new[to] = min(new[to], (x[0] + late + (0 if kept else 3), x[1] + ("K" if kept else "R")))
        new[2] = min(new[2], *((new[s][0] + 3, new[s][1] + "I") for s in (0, 1, 3)))
        new[3] = min(new[3], (new[2][0] + 3, new[2][1] + "I"))
        state = new
    assert (r.cost, r.audit) == min(state[0], state[3])


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_and_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{d}/conversations.parquet'")
    df = op12.op12_dialogue_repair(spark, d)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({op12.SQL})").fetchall())
    assert df.where("cost = 0").count() > 0 and df.where("audit = ''").select("repaired_sha256").distinct().collect() in ([], [(hashlib.sha256(b"").hexdigest(),)])
