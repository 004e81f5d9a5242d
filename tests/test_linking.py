"""Links of names in texts against a scan of all aliases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from bracketry.operators import linking

ALIASES = "kind int, target_id string, alias string, place int"


def plain(text, rows):
    """Every alias in order, its first place by a pattern."""
    spans, done = [], set()
    for kind, target, alias, _ in sorted(rows, key=lambda r: (-len(r[2]), r[0], r[1], r[3])):
        m = re.search(rf"\b{re.escape(alias)}\b", text or "", re.IGNORECASE | re.ASCII) if text and text.isascii() else None
        if (kind, target) in done or not m or any(s < m.end() and e > m.start() for s, e, *_ in spans):
            continue
        spans.append((m.start(), m.end(), kind, target, alias))
        done.add((kind, target))
    return sorted(spans)


def both(spark, docs, rows):
    a = spark.createDataFrame(rows, ALIASES)
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string").withColumns({c: F.lit(1) for c in ("spans", "kind", "w", "n", "alias")})
    out = [{r.id: [tuple(s) for s in r.spans] for r in linking.link_spans(d, a, automaton_letters=n).collect()} for n in (10**6, 0)]
    assert out[0] == out[1] and len(out[0]) == len(docs)
    return [out[0][i] for i in range(len(docs))]


def test_random_names(spark):
    rnd = random.Random(2)
    words = ["an", "ana", "Anan", "bo", "BO", "c", "d-e", "o'x", "x_1", "9"]
    rows = [(rnd.randrange(2), str(rnd.randrange(9)), " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3]))), i) for i in range(40)]
    rows = list({(k, a.lower()): (k, t, a, p) for k, t, a, p in rows}.values())
    docs = ["".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", "", "-"]) for _ in range(rnd.choice([0, 5, 60]))) for _ in range(80)]
    docs += [None, "", docs[0], docs[0], "an " * 5000]
    assert both(spark, docs, rows) == [plain(t, rows) for t in docs]


def test_overlaps_and_ties(spark):
    rows = [(0, "1", "Sean Stone", 0), (0, "1", "Stone", 1), (0, "2", "Stone Cold", 0), (1, "9", "Cup 12: Stone Cold", 0), (1, "9", "Cup 12", 1), (0, "3", "Cold", 0), (1, "3", "cold", 0)]
    docs = ["Sean Stone met Stone Cold at Cup 12.", "At CUP 12: stone cold won. Stone!", "Stones and Coldness", "cold stone", "the Cup 12 Cup 12: Stone Cold"]
    got = both(spark, docs, rows)
    assert got == [plain(t, rows) for t in docs]
    assert [s[4] for s in got[1]] == ["Cup 12: Stone Cold"]  # Stone's first place is taken, and no other one is tried
    assert got[2] == []
    assert [s[2:] for s in got[3]] == [(0, "3", "Cold"), (0, "1", "Stone")]  # of equal length: the first kind


def test_letters_beyond_ascii(spark):
    rows = [(0, "1", "José", 0), (0, "2", "İstan Bul", 0), (0, "3", "Ωmega x", 0)]
    docs = ["JOSÉ, josé and JosÉx", "an İSTAN BUL b", "ωMEGA X"]
    assert [[s[:2] for s in x] for x in both(spark, docs, rows)] == [[(15, 19)], [], []]  # no boundary beside such a letter
    a = spark.createDataFrame(rows, ALIASES)
    d = spark.createDataFrame([(t,) for t in docs], "text string")
    for n in (10**6, 0):
        out = linking.link_spans(d, a, word=linking.ALL_SCRIPTS, automaton_letters=n).collect()
        assert {r.text: [tuple(s)[:2] for s in r.spans] for r in out} == {"JOSÉ, josé and JosÉx": [(0, 4)], "an İSTAN BUL b": [(3, 12)], "ωMEGA X": [(0, 7)]}


def test_alias_table(spark):
    t = spark.createDataFrame([(0, 2, ["Bo Lee", "Lee"]), (0, 1, ["An Lee", "lee"]), (1, 5, ["Lee", None, "!!"])], "kind int, target_id int, names array<string>")
    assert sorted(map(tuple, linking.alias_table(t).collect())) == [(0, "1", 0, "An Lee"), (0, "1", 1, "lee"), (0, "2", 0, "Bo Lee"), (1, "5", 0, "Lee")]
    named = spark.createDataFrame([(" Ann  de Groot ",), ("Bo Li",), ("Solo",), (None,)], "n string")
    assert [r[0] for r in named.select(linking.person_names(F.col("n"))).collect()] == [["Ann  de Groot", "Groot"], ["Bo Li"], ["Solo"], [None]]


def test_pieces_give_the_text_again(spark):
    a = spark.createDataFrame([(0, "1", "Bo", 0), (0, "2", "ann", 0)], ALIASES)
    d = spark.createDataFrame([("Bo and Ann\U0001f600.",), ("none",), ("",), ("ann",)], "text string")
    got = linking.link_spans(d, a).select("text", linking.segments(F.col("text"), F.col("spans")).alias("p")).collect()
    assert all("".join(x.text for x in r.p) == r.text for r in got)
    assert [(x.text, x.target_id) for x in got[0].p] == [("Bo", "1"), (" and ", None), ("Ann", "2"), ("\U0001f600.", None)]


def test_no_aliases_and_no_texts(spark):
    none = spark.createDataFrame([], ALIASES)
    d = spark.createDataFrame([("Bo",), (None,)], "text string")
    assert [r.spans for r in linking.link_spans(d, none).collect()] == [[], []]
    assert linking.link_spans(d.limit(0), none).count() == 0


def test_work_grows_with_the_text(spark):
    """A text of a million letters in which most places match."""
    a = spark.createDataFrame([(0, str(i), "ab " * i + "ab", 0) for i in range(30)], ALIASES)
    d = spark.createDataFrame([("ab " * 300_000,)], "text string")
    assert len(linking.link_spans(d, a).first().spans) == 1
