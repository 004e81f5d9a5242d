"""Language identification by fusing evidence the Bayesian way.

Likelihoods of the text (byte trigrams of words, learned from labelled documents), of the language that the markup declares,
and priors of the host meet in one posterior. A host's prior is smoothed towards that of its address suffix, and that one
towards all texts; counts are sums of the posteriors from text alone, by grouped aggregation, and each page's own share is
taken out of the counts that judge it.
"""

from __future__ import annotations

import html
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_join_by_size, materialize

BUCKETS = 1 << 15
#: Labelled documents that a language needs.
MIN_DOCS = 3
#: Trigrams of a word go together: what they say counts in part.
TEMPER = 0.3
#: Pseudo-counts: of a suffix towards all, of a host towards its suffix, and of declarations that are right.
SUFFIX_PULL, HOST_PULL, DECLARED_PULL, DECLARED_RIGHT = 20.0, 10.0, 20.0, 0.8
MEMO = 300_000
#: Hosts, suffixes or declarations whose counts are broadcast whole; of more, the frequent ones are, the rest is joined by a shuffle.
BROADCAST_ROWS = 2_000

#: What hides text, and where each kind of it ends.
HIDING = regex.compile(r"(?i)<(!--|script\b|style\b|noscript\b|template\b)")
ENDS = {"!--": regex.compile("-->")} | {k: regex.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template")}
TAG = regex.compile(r"<[^>]*>")
DECLARED = regex.compile(r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})|<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*["']?([A-Za-z]{2,8})""")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def buckets_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of words in a row, and where each word's start."""
    crc = zlib.crc32
    lists = [[crc(w[i : i + 3]) & (BUCKETS - 1) for i in range(len(w) - 2)] for w in (b"^" + w + b"$" for w in words)]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


def visible(page: str) -> str:
    """Text of a page without comments, scripts and the like; what never ends hides nothing but its tag. One pass, however many do not end."""
    out, at, pos, endless = [], 0, 0, set()
    while m := HIDING.search(page, pos):
        kind, pos = m[1].lower(), m.end()
        end = None if kind in endless else ENDS[kind].search(page, pos)
        if end:
            out.append(page[at : m.start()])
            at = pos = end.end()
        else:
            endless.add(kind)
    text = " ".join([*out, page[at:]])
    last = text.rfind(">") + 1
    return html.unescape(TAG.sub(" ", text[:last]) + text[last:])


def read_page(page: Column) -> Column:
    """struct<text, declared>: the visible text and the primary tag of the language that the markup declares."""

    @F.arrow_udf("struct<text: string, declared: string>")
    def parts(pages: pa.Array) -> pa.Array:
        texts, tags = [], []
        for p in pages.to_pylist():
            m = DECLARED.search(p or "")
            texts.append(visible(p or ""))
            tags.append((m[1] or m[2]).lower() if m else None)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(tags, pa.string())], ["text", "declared"])

    return parts(page.cast("string"))


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every bucket in each, from all rows of (text, lang).

    Every language of MIN_DOCS documents is told apart. What comes to the driver grows with the languages, not with the rows.
    """
    sizes = labelled.where("lang is not null and text is not null").groupBy("lang").count().where(F.col("count") >= MIN_DOCS)
    names = sorted(r["lang"] for r in sizes.collect())

    def partial(batches):
        own: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for b in batches:
            of: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of[lang].update(words_of(text))
            for lang, c in of.items():
                words = list(c)
                at, starts = buckets_of(words)
                times = np.repeat(np.fromiter(c.values(), np.int64, len(c)), np.diff(np.append(starts, len(at))))
                own[lang] += np.bincount(at, times, BUCKETS).astype(np.int64)
        for lang, x in own.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "at": pa.array(at, pa.int32()), "n": pa.array(x[at], pa.int64())})

    if not names:
        return [], np.zeros((BUCKETS, 0))
    rows = labelled.where(F.col("lang").isin(names) & F.col("text").isNotNull()).select("text", "lang").mapInArrow(partial, "lang string, at int, n long")
    # at most BUCKETS rows a language
    got = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts = np.full((BUCKETS, len(names)), 0.1)
    counts[np.array(got["at"], int), [names.index(x) for x in got["lang"]]] += np.array(got["n"], float)
    return names, np.log(counts / counts.sum(0))


def likelihoods(text: Column, model: np.ndarray, spark) -> Column:
    """array<double>: tempered log-likelihood of a text in each language; all 0 for a null or empty text."""
    send = spark.sparkContext.broadcast(model)
    memo: dict[bytes, int] = {}
    rows = [np.zeros((1 << 12, model.shape[1]))]

    @F.arrow_udf("array<double>")
    def judged(texts: pa.Array) -> pa.Array:
        out = []
        values = texts.to_pylist()
        for k in range(0, len(values), 256):
            lists = [words_of(t or "") for t in values[k : k + 256]]
            if len(memo) > MEMO:
                memo.clear()
            new = [w for w in set(itertools.chain.from_iterable(lists)) if w not in memo]
            if new:
                known, upto = len(memo), len(memo) + len(new)
                if upto > len(rows[0]):
                    rows[0] = np.concatenate([rows[0], np.zeros((upto, model.shape[1]))])
                at, starts = buckets_of(new)
                rows[0][known:upto] = np.add.reduceat(send.value[at], starts, axis=0)
                memo.update(zip(new, range(known, upto), strict=True))
            for ws in lists:
                own = np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))
                out.append((TEMPER * rows[0][own].sum(0)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return judged(text)


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fuse(judged: DataFrame, names: list[str]) -> DataFrame:
    """judged (columns host, suffix, declared, ll) with lang, confidence and text_lang.

    Missing evidence says nothing: a row without a host or suffix has the next wider prior, one without a text or a
    declaration a flat likelihood. Ties go to the first language by name. Without labelled documents lang is null.
    """
    if not names:
        none = F.lit(None).cast("string")
        return judged.withColumns({"lang": none, "confidence": F.lit(0.0), "text_lang": none})
    n = len(names)
    d = judged.withColumn("p", _softmax(F.col("ll")))
    sums = lambda: F.array(*[F.sum(F.get("p", i)) for i in range(n)])
    total = d.agg(*[F.sum(F.get("p", i)) for i in range(n)]).first()
    every = np.array([x or 0.0 for x in total]) + 1.0
    wide = F.array(*[F.lit(float(x)) for x in every / every.sum()])
    evidence = {k: materialize(d.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("_n"), sums().alias(f"by_{k}")), k) for k in ("host", "suffix", "declared")}
    for key, counts in evidence.items():
        d = left_join_by_size(d, counts, [key], "_n", BROADCAST_ROWS)
    own = lambda c, i: F.coalesce(F.greatest(F.get(c, i) - F.get("p", i), F.lit(0.0)), F.lit(0.0))
    size = lambda c: F.coalesce(F.greatest(F.aggregate(c, F.lit(0.0), lambda a, y: a + y) - 1, F.lit(0.0)), F.lit(0.0))
    suffix = F.transform(wide, lambda w, i: (own("by_suffix", i) + SUFFIX_PULL * w) / (size("by_suffix") + SUFFIX_PULL))
    d = d.withColumn("suffix_prior", suffix)
    d = d.withColumn("prior", F.transform("suffix_prior", lambda w, i: (own("by_host", i) + HOST_PULL * w) / (size("by_host") + HOST_PULL)))
    langs = F.array(*[F.lit(x) for x in names])
    right = F.transform(langs, lambda x: F.when(x == F.col("declared"), F.lit(DECLARED_RIGHT)).otherwise((1 - DECLARED_RIGHT) / max(n - 1, 1)))
    said = F.transform(right, lambda r, i: F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log((own("by_declared", i) + DECLARED_PULL * r) / (F.get(F.array(*[F.lit(float(x)) for x in every]), i) + DECLARED_PULL))))
    d = d.withColumn("post", _softmax(F.transform("ll", lambda x, i: x + F.log(F.get("prior", i)) + F.get(said, i))))
    best = lambda c: F.get(langs, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return d.withColumns({"lang": best(F.col("post")), "confidence": F.array_max("post"), "text_lang": F.when(F.array_max("p") > F.array_min("p"), best(F.col("p")))})


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """rows (text, declared, host, suffix and any others) less text, with lang, confidence and text_lang.

    labelled has text and lang. Columns of those names are replaced. Repeated rows are judged one by one, in the same way.
    """
    names, model = learn(labelled)
    spark = rows.sparkSession
    ll = likelihoods(F.col("text"), model, spark) if names else F.array().cast("array<double>")
    judged = materialize(rows.withColumn("ll", ll).drop("text", "lang", "confidence", "text_lang"), "judged")
    keep = [c for c in judged.columns if c != "ll"]
    return fuse(judged, names).select(*keep, "lang", "confidence", "text_lang")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))
