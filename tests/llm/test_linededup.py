"""Line dedup against every run of lines."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from bracketry.llm import linededup as L
from bracketry.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

SMALL = "/root/testdata/sf0.001"


def brute(docs: list[tuple], least: int) -> dict:
    """Lines in any later copy of a run with at least so many words, over all runs; docs are in order."""
    full = {}
    for doc, text in docs:
        lines = [(i, " ".join(x.split(" "))) for i, x in enumerate((text or "").split("\n"))]
        full[doc] = [(i, " ".join(x.split())) for i, x in lines if x.split()]
    runs = defaultdict(list)
    for doc, _ in docs:
        ls = full[doc]
        for s in range(len(ls)):
            for e in range(s, len(ls)):
                if sum(len(x.split()) for _, x in ls[s : e + 1]) >= least:
                    runs[tuple(x for _, x in ls[s : e + 1])].append((doc, s))
    gone = defaultdict(set)
    for run, at in runs.items():
        for doc, s in at[1:]:
            gone[doc] |= {full[doc][s + k][0] for k in range(len(run))}
    return {d: sorted(gone[d]) for d, _ in docs}


@pytest.mark.parametrize("seed", range(6))
def test_all_runs(spark, seed):
    r = random.Random(seed)
    pool = ["a", "b b", "c c c", "d", "e  e", "", "  ", "f f f f f f"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 14)))) for i in range(r.choice([2, 9]))]
    least = r.choice([1, 3, 6, 12])
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least=least).collect()
    want = brute(docs, least)
    assert {x.doc_id: x.removed for x in got} == want
    for x in got:
        lines = dict(docs)[x.doc_id].split("\n")
        assert x.text == "\n".join(line for i, line in enumerate(lines) if i not in want[x.doc_id])
        assert x.n_lines == len(lines)


def test_a_run_within_one_document(spark):
    run = "\n".join(f"line {k} with five words" for k in range(12))
    docs = spark.createDataFrame([(1, run + "\n" + run + "\n" + run), (2, "short line")], "doc_id long, text string")
    got = {x.doc_id: x.removed for x in L.dedup_lines(docs).collect()}
    assert got == {1: list(range(12, 36)), 2: []}


def test_maximal_runs(spark):
    long = [f"line {k} has five words" for k in range(40)]
    docs = {1: ["own start", *long, "own end"], 2: [*long[:15], "a break", *long[20:]], 3: ["x", *long, "y"], 4: long[:5]}
    got = L.repeated_runs(spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs.items()], "doc_id long, text string")).collect()
    runs = {(r.d, tuple(r.lines), r.first_d, r.first_line) for r in got}
    assert runs == {(2, tuple(range(15)), 1, 1), (2, tuple(range(16, 36)), 1, 21), (3, tuple(range(1, 41)), 1, 1)}


def test_most_lines_are_one_line(spark):
    rows = [(k, "\n".join(["the license line"] * 30 + [f"own {k}"])) for k in range(40)]
    got = {x.doc_id: x.removed for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=50).collect()}
    assert got == brute(rows, 50)


def test_edge_rows(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage, 7, "x"), (2, None, 7, "x"), (3, "", 7, None), (4, passage + "\nrest", 7, "x"), (4, passage + "\nrest", 7, "x"), (None, "start\n" + passage, 7, "x"), (5, "z " * 30_000, 7, "x"), (6, "\n\n\n", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, removed string")
    got = L.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "removed"]
    rows = sorted(((x.doc_id is not None, x.doc_id), x.text, x.n_lines, x.removed) for x in got.collect() if x.text is not None)
    assert [(k[1], t[:5], n, r) for k, t, n, r in rows] == [(None, "start", 2, []), (1, "", 1, [0]), (3, "", 1, []), (4, "rest", 2, [0]), (4, "rest", 2, [0]), (5, "z z z", 1, []), (6, "\n\n\n", 4, [])]
    assert [(x.doc_id, x.n_lines, x.removed) for x in got.collect() if x.text is None] == [(2, 0, [])]
    assert L.dedup_lines(docs.where("false")).count() == 0


def test_query_against_sql(spark):
    assert oracle.difference(QUERIES["op8_line_dedup"](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL["op8_line_dedup"]) == ""
