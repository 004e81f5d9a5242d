"""Language identification: held-out accuracy, each kind of evidence, and rows with gaps."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracketry.llm import langid as L
from bracketry.llm.common import crc_mod
from bracketry.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = {"en": "the and of that with this have from they will", "de": "und der die das nicht mit sich auf ist ein", "fr": "les des une est dans pour que qui avec sur"}


def labelled(spark):
    return spark.createDataFrame([(" ".join(w.split()[i:] + w.split()[:i]), lang) for lang, w in WORDS.items() for i in range(10)] + [(None, "en"), ("lone words", "xx"), ("no label", None)], "text string, lang string")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, text string, declared string, host string, suffix string")


def lang(found):
    return {r.id: r.lang for r in found.collect()}


def test_held_out_documents(spark):
    d = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("text <> ''")
    train, held = d.where(crc_mod(F.col("doc_id"), 5) != 0), d.where(crc_mod(F.col("doc_id"), 5) == 0)
    none = F.lit(None).cast("string")
    found = L.identify(held.select("doc_id", F.col("lang").alias("truth"), "text", none.alias("declared"), none.alias("host"), none.alias("suffix")), train.select("text", "lang"))
    right = found.select(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.95


def test_text_alone(spark):
    got = L.identify(rows(spark, *[(i, w, None, None, None) for i, w in enumerate(WORDS.values())]), labelled(spark))
    assert lang(got) == dict(enumerate(WORDS))
    assert all(0 < r.confidence <= 1 and r.lang == r.text_lang for r in got.collect())


def test_a_host_decides_what_a_text_does_not(spark):
    known = [(i, WORDS["de"], None, "h.example", "example") for i in range(30)] + [(i + 50, WORDS["fr"], None, "g.example", "example") for i in range(30)]
    got = lang(L.identify(rows(spark, *known, (100, "zzz", None, "h.example", "example"), (101, "zzz", None, "g.example", "example")), labelled(spark)))
    assert (got[100], got[101]) == ("de", "fr")


def test_a_new_host_leans_on_its_suffix(spark):
    known = [(i, WORDS["de"], None, f"h{i}.de", "de") for i in range(40)] + [(i + 50, WORDS["en"], None, f"g{i}.com", "com") for i in range(40)]
    got = lang(L.identify(rows(spark, *known, (100, None, None, "new.de", "de"), (101, "", None, "new.com", "com")), labelled(spark)))
    assert (got[100], got[101]) == ("de", "en")


def test_markup_is_evidence_and_text_can_outweigh_it(spark):
    long_text = " ".join([WORDS["en"]] * 20)
    got = lang(L.identify(rows(spark, (1, None, "fr", None, None), (2, long_text, "fr", None, None)), labelled(spark)))
    assert got == {1: "fr", 2: "en"}


def plain(pages: list[tuple], known: list[tuple]) -> dict:
    """(lang, confidence, text_lang) of each id from the formula, one page after the other; a language is None where two are as likely."""
    names = sorted(x for x in {lang for t, lang in known if t is not None and lang is not None} if sum(t is not None and lang == x for t, lang in known) >= L.MIN_DOCS)

    def grams(text):
        for w in (text or "").lower().encode().split():
            w = b"^" + w + b"$"
            yield from (zlib.crc32(w[i : i + 3]) % L.BUCKETS for i in range(len(w) - 2))

    counts = np.full((len(names), L.BUCKETS), 0.1)
    for text, lang in known:
        if lang in names:
            for g in grams(text):
                counts[names.index(lang), g] += 1
    logs = np.log(counts / counts.sum(1, keepdims=True))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = [L.TEMPER * sum((logs[:, g] for g in grams(t)), np.zeros(len(names))) for _, t, *_ in pages]
    p = [softmax(x) for x in ll]
    every = sum(p) + 1
    wide, n, out = every / every.sum(), len(names), {}
    for i, (page, _, declared, host, suffix) in enumerate(pages):
        def others(k, value, i=i):
            return [p[j] for j, r in enumerate(pages) if value is not None and r[k] == value and j != i]

        def pulled(own, towards, pull):
            return (sum(own, np.zeros(n)) + pull * towards) / (len(own) + pull)

        prior = pulled(others(3, host), pulled(others(4, suffix), wide, L.SUFFIX_PULL), L.HOST_PULL)
        right = np.array([L.DECLARED_RIGHT if x == declared else (1 - L.DECLARED_RIGHT) / (n - 1) for x in names])
        said = 0 if declared is None else np.log((sum(others(2, declared), np.zeros(n)) + L.DECLARED_PULL * right) / (every + L.DECLARED_PULL))
        post = softmax(ll[i] + np.log(prior) + said)
        clear = lambda x: np.diff(np.sort(x))[-1] > 1e-9
        out[page] = (names[int(post.argmax())] if clear(post) else None, float(post.max()), names[int(p[i].argmax())] if clear(p[i]) else None)
    return out


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_posterior_against_the_formula(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    r = np.random.default_rng(3)
    every = " ".join(WORDS.values()).split()
    pages = []
    for i in range(120):
        own = WORDS[["en", "de", "fr"][r.integers(3)]].split() + every * int(r.integers(2))
        text = " ".join(r.choice(own, r.integers(0, 5))) if i % 9 else None
        host = None if i % 7 == 0 else "hot.de" if i % 3 == 0 else f"h{r.integers(30)}.{'de' if i % 2 else 'com'}"
        pages.append((i, text, [None, "de", "fr", "zz"][r.integers(4)], host, host and host.split(".")[1]))
    train = [tuple(x) for x in labelled(spark).collect()]
    got = {x.id: x for x in L.identify(rows(spark, *pages), labelled(spark)).collect()}
    for page, (name, confidence, text_lang) in plain(pages, train).items():
        assert got[page].confidence == pytest.approx(confidence, abs=1e-9)
        assert got[page].lang == (name or got[page].lang) and got[page].text_lang == (text_lang or got[page].text_lang)


def test_many_languages(spark):
    names = [f"l{k:03d}" for k in range(90)]
    known = spark.createDataFrame([(f"{n}aa {n}bb {n}cc", n) for n in names for _ in range(3)], "text string, lang string")
    got = lang(L.identify(rows(spark, *[(k, f"{n}aa {n}bb", None, None, None) for k, n in enumerate(names)]), known))
    assert got == dict(enumerate(names))


def test_pages_that_never_close_what_they_open():
    for page in ("<script " * 100_000, "<!-- " * 100_000, "<" * 400_000, "<script>a</script" * 20_000, "<html " * 80_000):
        assert L.visible(page) is not None and L.DECLARED.search(page) is None
    assert L.visible("a<script>b</SCRIPT >c<style>d").split() == ["a", "c", "d"]
    assert L.visible("a<!-- <b> --> c <d e").split() == ["a", "c", "<d", "e"]


def test_gaps(spark):
    got = L.identify(rows(spark, (1, None, None, None, None), (2, "", None, None, None), (None, WORDS["fr"], "zz", "", ""), (4, "w " * 50_000, None, None, None)), labelled(spark))
    found = {r.id: r for r in got.collect()}
    assert len(found) == 4 and found[1].lang == found[2].lang and found[1].text_lang is None and found[None].lang == "fr"
    extra = rows(spark, (1, WORDS["de"], None, None, None)).withColumn("lang", F.lit("x")).withColumn("confidence", F.lit(9)).withColumn("other", F.lit(1))
    assert L.identify(extra, labelled(spark)).columns == ["id", "declared", "host", "suffix", "other", "lang", "confidence", "text_lang"]
    none = L.identify(rows(spark, (1, "x", None, None, None)), labelled(spark).where("false"))
    assert [(r.lang, r.confidence) for r in none.collect()] == [(None, 0.0)]
    assert L.identify(rows(spark, (1, "x", None, None, None)).where("false"), labelled(spark)).count() == 0


@pytest.mark.parametrize(("page", "declared", "text"), [('<html lang="fr-CA"><p>a&amp;b</p>', "fr", "a&b"), ("<HTML LANG=de><script>x</script>y", "de", "y"), ('<meta http-equiv="Content-Language" content="es">', "es", ""), ("plain", None, "plain"), (None, None, ""), ("", None, "")])
def test_pages(spark, page, declared, text):
    r = spark.createDataFrame([(page,)], "html string").select(L.read_page(F.col("html")).alias("r")).first().r
    assert (r.declared, r.text.strip()) == (declared, text)


def test_hosts(spark):
    d = spark.createDataFrame([("HTTP://User@A.Example.COM:80/x",), ("no address",), (None,)], "url string").select(L.host_of(F.col("url")).alias("h"))
    assert [tuple(r) for r in d.select("h", L.suffix_of(F.col("h"))).collect()] == [("a.example.com", "com"), (None, None), (None, None)]


def test_query(spark):
    got = QUERIES["op3_language_id"](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count() + spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert got.count() == n
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    assert got.join(truth, "doc_id").where("lang = truth").count() > 0.9 * truth.count()
