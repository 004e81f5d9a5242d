"""Decontamination against every window of every document."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from bracketry.llm import decontaminate as D
from bracketry.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

SMALL = "/root/testdata/sf0.001"
SPLIT = regex.compile(r"[^\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPLIT.split((text or "").lower()) if w]


def shingles(ws: list[str]) -> list[str]:
    return [" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)]


def similarity(a: list[str], b: list[str]) -> float:
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(docs: dict, items: dict) -> set:
    found = set()
    for d, text in docs.items():
        own = shingles(words(text))
        for i, t in items.items():
            theirs = shingles(words(t))
            m = min(len(own), len(theirs))
            if m and any(similarity(own[s : s + m], theirs) >= 0.8 for s in range(len(own) - m + 1)):
                found.add((d, i))
    return found


def test_every_window(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: " ".join(text(r.choice([30, 45, 60]))) for k in range(8)}
    items |= {8: "too short to count", 9: None, 10: "", 11: "five words are just enough", 12: items[0]}
    docs = {}
    for k in range(60):
        own, planted = text(r.randrange(0, 150)), items[r.randrange(8)].split()
        if k % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = planted
        elif k % 3 == 1:
            planted[len(planted) // 2] = "changed"
            own[:0] = planted
        elif k % 2:
            own += planted[: len(planted) // 2]
        docs[k] = " ".join(own).replace(" w3 ", ", W3. ")
    docs |= {100: None, 101: "", 102: "Five words, are just enough!", 103: items[2] + " " + items[2], 104: "w1 " * 20_000}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = D.contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items)
    for x in got:
        own = shingles(words(docs[x.doc_id]))[x.start_word : x.start_word + x.n_words - 4]
        assert similarity(own, shingles(words(items[x.item_id]))) == pytest.approx(x.similarity)
        best = max(similarity(shingles(words(docs[x.doc_id]))[s : s + len(own)], shingles(words(items[x.item_id]))) for s in range(len(shingles(words(docs[x.doc_id]))) - len(own) + 1))
        assert x.similarity == pytest.approx(best)


def test_the_index_finds_all_within_the_radius(spark):
    r = np.random.default_rng(1)
    items = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 5)]
    prints = set()
    for x in items:
        for n in (0, 1, 8, 15, 16, 17, 30):
            bits = r.choice(64, n, replace=False)
            y = (x & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)
            prints.add(y - 2**64 if y >> 63 else y)
    t = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item long, own_print long")
    got = {tuple(x) for x in D.lookup(spark.createDataFrame([(x,) for x in prints], "print long"), t).collect()}
    gap = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(p, k) for p in prints for k, x in enumerate(items) if gap(p, x) <= D.RADIUS}


def test_recall_of_the_radius(spark):
    r = random.Random(5)
    items = {k: [f"i{k}w{j}" for j in range(r.choice([40, 80, 150]))] for k in range(6)}
    docs = {}
    for d in range(400):
        own = list(items[d % 6])
        for _ in range(1 + d % 4):
            own[r.randrange(len(own))] = f"edit{r.random()}"
        docs[d] = " ".join([f"d{d}a{j}" for j in range(20)] + own + [f"d{d}b{j}" for j in range(20)])
    items = {k: " ".join(v) for k, v in items.items()}
    got = {(x.doc_id, x.item_id) for x in D.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 150 and got <= want
    assert len(got) >= 0.97 * len(want)


def test_fingerprint_is_the_majority(spark):
    rows = [[1, 2, 3], [-1, 5, 7, 7], [2**62, -(2**63)]]
    got = spark.createDataFrame([(x,) for x in rows], "h array<long>").select(D.fingerprint("h").alias("f")).collect()
    for hs, (f,) in zip(rows, got, strict=True):
        assert f & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum((h & (2**64 - 1)) >> b & 1 for h in hs) > len(hs))


def test_edge_rows(spark):
    item = " ".join(f"word{k}" for k in range(30))
    rows = [(1, item, 1), (1, item, 1), (2, None, 2), (None, item, 3), (None, "clean text of five words or more", 3), (3, "", 4), (4, "clean text of five words or more", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t long").withColumn("item_id", F.lit(0)).withColumn("d", F.lit("x"))
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x")], "item_id long, text string, doc_id string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect() if r.text is not None) == [(False, 3, ""), (False, 4, rows[6][1]), (True, 0, rows[4][1])]
    assert kept.where("text is null").count() == 1
    assert D.decontaminate(docs, items.where("false")).count() == len(rows)
    assert D.decontaminate(docs.where("false"), items).count() == 0
    assert D.contaminated(docs, items).where("doc_id = 1").count() == 1


def test_query_against_sql(spark):
    assert oracle.difference(QUERIES["op2_decontamination"](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL["op2_decontamination"]) == ""
