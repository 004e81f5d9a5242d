"""Quality rules against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from bracketry.llm import quality as Q
from bracketry.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def normal(line: str) -> str:
    return " ".join(WORDS.findall(re.sub("[0-9]", "0", line.lower())))


def frequent(docs: list[tuple]) -> dict:
    """Frequent lines of each host."""
    having, hosts = defaultdict(set), defaultdict(set)
    for doc, text, host in docs:
        document = (doc, text if doc is None else None)
        hosts[host or ""].add(document)
        for x in (text or "").split("\n"):
            if normal(x):
                having[host or "", normal(x)].add(document)
    return {k for k, v in having.items() if len(v) > max(Q.MAX_SHARING, Q.MAX_SHARE * len(hosts[k[0]]))}


def removed(docs: list[tuple]) -> list[int]:
    often = frequent(docs)
    return [sum(len(normal(x).split(" ")) for x in (text or "").split("\n") if (host or "", normal(x)) in often) for _, text, host in docs]


def check(spark, docs, schema="doc_id long, text string, source string"):
    got = sorted(map(tuple, Q.rules(spark.createDataFrame(docs, schema)).collect()), key=lambda r: str(r))
    want = []
    for (doc, text, *_), gone in zip(docs, removed([d[:3] for d in docs]), strict=True):
        f = figures(text)
        want.append((doc, *f, gone, not f[-1] and gone <= 0.5 * f[0]))
    assert got == sorted(want, key=lambda r: str(r))


@pytest.mark.parametrize("seed", range(3))
def test_counts(spark, seed):
    r = random.Random(seed)
    lines = ["Menu 12 | Home", "menu 99 |  home", "a b c d e f", "#tag & more <b>", "", " \t ", "g h i j k l m n o p q", "one", "É ü 日本 words here"]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 9))), r.choice(["h1", "h2", None])) for i in range(80)]
    check(spark, docs)


def test_frequent_lines_deplete(spark):
    shared = "This very same line stands on every page of the site"
    docs = [(i, f"{shared} {i % 10}\n" + " ".join(f"own{i}x{k}" for k in range(4)), "host") for i in range(40)]
    docs += [(100, f"{shared} 5\n" + " ".join(f"good{k}" for k in range(40)), "host"), (101, f"{shared} 5 and a lot more that is its own", "elsewhere")]
    check(spark, docs)
    kept = {r.doc_id for r in Q.rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {100, 101}


def test_documents_are_counted_not_rows_nor_texts(spark):
    text = "the same document of a good ten words or more here"
    schema = "doc_id long, text string, source string"
    assert Q.rules(spark.createDataFrame([(i, text, "host") for i in range(60)], schema)).where("kept").count() == 0
    assert Q.rules(spark.createDataFrame([(i % 20, text, "host") for i in range(60)], schema)).where("kept").count() == 60
    check(spark, [(i % 30, f"{text}\nnumber {'x' * (i % 7)} of it", "host") for i in range(60)] + [(None, f"{text} again {k}", "host") for k in "abc"])


def test_a_line_of_a_large_host(spark):
    docs = [(i, ("a line that a few dozen documents have\n" if i < 25 else "") + " ".join(f"w{i}x{k}" for k in range(12)), "host") for i in range(3000)]
    docs += [(5000 + i, d[1], "small") for i, d in enumerate(docs[:25])]
    check(spark, docs)


def test_cleaned_texts(spark):
    menu, rest = "Home | News 7 | About", [" ".join(f"own{i}x{k}" for k in range(30)) for i in range(30)]
    docs = [(i, f"{menu}\n{rest[i]}\n\n  {menu.upper()}", "host", 5) for i in range(30)]
    docs += [(100, None, "host", 5), (101, f"{menu}\nfour own words here", "host", 5), (102, f"{menu}\n{rest[0]}", None, 5), (0, docs[0][1], "host", 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_words long")
    got = Q.clean(d)
    assert got.columns == d.columns
    want = [(i, f"{rest[i]}\n", "host", 5) for i in range(30)] + [(102, docs[32][1], None, 5), (0, f"{rest[0]}\n", "host", 6)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.doc_id for r in Q.rules(d).where("kept").collect()} == {r.doc_id for r in got.collect()}


def test_edge_rows(spark):
    docs = [(1, None, None), (2, "", "h"), (None, "ten words or more are in this text here for one", "h"), (3, "w " * 30_000, "h"), (3, "w " * 30_000, "h")]
    check(spark, docs)
    check(spark, [(*d, 5, True) for d in docs], "doc_id long, text string, source string, n_words int, kept boolean")
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.rules(empty).count() == 0


def test_query_against_sql(spark):
    assert oracle.difference(QUERIES["op9_quality"](spark, SMALL), oracle.connect(SMALL), ORACLE_SQL["op9_quality"]) == ""
