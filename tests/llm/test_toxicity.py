"""Toxicity: folding, matching, exceptions, and accuracy on labels that were held out."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from bracketry.llm import toxicity as T
from bracketry.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("text", "folded"), [("IDIOT", "idiot"), ("id1ot", "idiot"), ("c10wn", "ciown"), ("CLOWN", "ciown"), ("ìdíöt", "idiot"), ("іdiot", "idiot"), ("$tup1d!!", "stupid  "), ("2013", "2013"), ("at 5 pm", "at 5 pm"), ("ｉｄｉｏｔ", "idiot"), ("id\u200biot", "idiot"), ("clo\u00adwn", "ciown"), ("ﬁ\u200d\ufeffne", "fine"), ("сосна", "cocha"), ("", "")])
def test_fold(text, folded):
    assert T.fold(text) == folded


WEIGHTS, PHRASES = (("ciown", 2.0), ("scum", 1.5)), ("clown fish",)


@pytest.mark.parametrize(("text", "n"), [("you clown", 1), ("you c10wn", 1), ("clowns", 0), ("aclown", 0), ("clown fish", 0), ("clown fish, you clown", 1), ("clown, scum; CLOWN", 3), ("", 0), ("clown\nfish", 1)])
def test_matches(text, n):
    assert T.matches(text, WEIGHTS, PHRASES)[0] == n


def plain_score(text: str, model: T.Model) -> tuple[float, int]:
    """Every place of every term, one after the other."""
    folded = T.fold(text)

    def places(term: str, whole: bool):
        for i in range(len(folded) - len(term) + 1):
            after = folded[i + len(term) : i + len(term) + 1]
            if folded[i : i + len(term)] == term and not folded[max(0, i - 1) : i].isalpha() and not (whole and after.isalpha()):
                yield i, i + len(term)

    shields = [x for p in model.phrases for x in places(T.fold(p), True)]
    found = [w for term, w in model.weights for a, b in places(T.fold(term.rstrip("*")), term[-1] != "*") if not any(s <= a and b <= e for s, e in shields)]
    total, words = sum(found), text.count(" ") + text.count("\n") + 1
    x = model.bias + sum(k * v for k, v in zip(model.slopes, (min(1, math.log(1 + total) / 5), min(1, total / words**0.5 / 4), min(1, 5 * total / words)), strict=True))
    return 1 / (1 + math.exp(-x)), len(found)


def test_scores_against_every_place_of_every_term(spark):
    r = random.Random(2)
    model = T.Model((("ciown", 2.0), ("scum", 1.5), ("idio*", 0.7)), ("clown fish", "pond scum", "fish idiot proof"), -2.0, (1.0, 2.5, 0.5))
    pool = ["clown", "CL0WN", "fish", "pond", "scum", "idiots", "idiot", "proof", "clo\u00adwn", "fine", "scum!", "aclown", "\n", "сlown"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, 30)))) for i in range(200)]
    got = {x.doc_id: x for x in T.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc, text in rows:
        score, n = plain_score(text, model)
        assert got[doc].n_toxic == n and got[doc].toxicity == pytest.approx(score) and got[doc].toxic == (score >= T.THRESHOLD)


def test_weights_against_plain_counts(spark):
    r = random.Random(4)
    mild, harsh = [f"{c}{v}{d}{w}" for c in "bdfgkmnp" for v in "aeu" for d in "bdgkmnr" for w in ("af", "eg", "ok", "um", "ix")], ["numpty", "wazzock", "plonker"]
    rows = []
    for i in range(600):
        words = [r.choice(mild) for _ in range(20)] + ([r.choice(harsh) for _ in range(3)] if i % 4 == 0 else [harsh[0]] if i % 50 == 1 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    used = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(d.drop("toxic"), d.select("doc_id", "toxic"))
    words, of = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for _, text, y in used:
        own = Counter(T.fold(text).split())
        of[y].update({w: min(k, T.CAPPED) for w, k in own.items()})
        words[y].update(own)
    share = {y: sum(words[y].values()) for y in (0, 1)}
    odds = (share[0] + 1) / (share[1] + 1)
    want = {T.fold(w): math.log((of[1][T.fold(w)] + 0.5) / (of[0][T.fold(w)] + 0.5) * odds) for w in harsh}
    got = dict(model.weights)
    assert {w: got[w] for w in want if w in got} == pytest.approx({w: want[w] for w in want if w in got})
    assert all(w in got or any(k[-1] == "*" and w.startswith(k[:-1]) for k in got) for w in want)
    assert not any(T.fold(w) in got for w in mild)


def test_many_terms_and_many_phrases():
    text = "clown fish " * 40_000 + "clown"
    assert T.matches(text, WEIGHTS, PHRASES) == (1, 2.0)


def test_longer_texts_weigh_less():
    a, b = (T.features("clown " + "fine " * k, WEIGHTS, PHRASES) for k in (5, 500))
    assert a[0][1] > b[0][1] and a[0][2] > b[0][2] and a[0][0] == b[0][0]


def test_held_out_labels(spark):
    labels = dict(spark.read.parquet(f"{MIDDLE}/labels.parquet").where("toxic is not null").select("doc_id", "toxic").collect())
    rows = QUERIES["op7_toxicity"](spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    found = sum(1 for y, p in judged if y and p)
    assert found >= 0.7 * sum(y for y, _ in judged)
    assert sum(1 for y, p in judged if p and not y) <= 0.02 * len(judged)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    others = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    assert T.fit(docs, others.select("doc_id", "toxic").unionByName(flipped.select("doc_id", "toxic"))) == T.fit(docs, labels)


def test_edge_rows(spark):
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "fine " * 100_000, 5, "x"), (4, "you clown", 5, "x"), (4, "you clown", 5, "x"), (None, "you clown", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, toxicity string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.classify(docs, T.fit(docs, none))
    assert got.columns == ["doc_id", "text", "toxicity", "n_toxic", "toxic"]
    assert got.count() == len(rows)
    model = T.Model(WEIGHTS, PHRASES, -4.0, (4.0, 4.0, 4.0))
    scored = {(r.doc_id, r.toxic, r.n_toxic) for r in T.classify(docs, model).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0)} <= scored
    assert T.classify(docs.where("false"), model).count() == 0
    some = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert isinstance(T.fit(docs, some), T.Model)
