"""How far the sources of a language differ in their terms, and which terms a source has more of.

A term's counts in the sources of its language are a sparse vector. Terms with equal vectors differ equally between any two
sources, so each pair of sources that a distinct vector has is evaluated once and counts as many times as terms have the
vector. Pairs of which a vector has one source or none are not listed: what they add depends on one count alone and comes from
running sums over a source's distinct counts, so that the work is the pairs that occur and the pairs that are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, join_by_size, materialize

#: The scale of shares.
SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of UTF-8 in terms: A-Z as a-z; what no term has is a space.
LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
#: Bytes of text that are counted at a time.
STRETCH = 8 << 20
MIN_DOCS, TOP_TERMS = 30, 50


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 and the floor of SCALE times the smoothed share, as exact integers at any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + SMOOTH), whole(total + SMOOTH * n_terms))
    return F.when(n_terms > 0, 1 + part)


def cells(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, text) with nulls as ''."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of (lang, source, text), a row for each term of a group in a stretch of texts."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STRETCH, side="right")))
            yield _counted(batch.slice(start, stop - start))
            start = stop


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pa.concat_arrays([batch.column("text").cast(pa.string())])
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)
    letters = LETTERS[np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    plain = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(letters)])
    words = pc.split_pattern(plain, " ")
    coded = words.flatten().dictionary_encode()
    terms, width = coded.dictionary, max(1, len(coded.dictionary))
    known: dict[tuple, int] = {}
    group = np.array([known.setdefault(g, len(known)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    doc = np.repeat(np.arange(len(text), dtype=np.int64), np.diff(words.offsets.to_numpy()))
    own, n = np.unique(doc * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    key, at = np.unique(group[own // width] * width + own % width, return_inverse=True)
    whole = np.bincount(at, n, len(key)).astype(np.int64)
    docs = np.bincount(at, minlength=len(key))
    named = terms.take(pa.array(key % width))
    langs, sources = (pa.array([g[i] for g in known], pa.string()).take(pa.array(key // width)) for i in (0, 1))
    out = pa.RecordBatch.from_arrays([langs, sources, named, pa.array(whole), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "n_docs"])
    return out.filter(pc.not_equal(named, ""))


def vectors(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, vector) of each term in at least min_docs documents of its language; vector: array<struct<source, n>>, sorted.

    Tasks count stretches of text as they read them; what they counted is added up. A vector is as long as a language has
    sources at most.
    """
    each = rows.where("text <> ''").select("lang", "source", "text").mapInArrow(frugal(count_terms), "lang string, source string, term string, n long, n_docs long")
    counts = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    by = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("vector"))
    return by.where(F.col("n_docs") >= min_docs).select("lang", "term", "total", F.array_sort("vector").alias("vector"))


def groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, n_entries, n_terms, lang_total, zero) of every group that occurs; zero: the share of a term it lacks."""
    own = kept.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_entries"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("lang_total"))
    all_ = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = all_.fillna(0, ["total", "n_entries", "n_terms", "lang_total"])
    return filled.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("n_terms")), F.lit(0)))


def _both(shared: DataFrame) -> DataFrame:
    """(lang, a, b, value): for pairs of sources a < b in a vector, what the sum over terms has beyond the two one-sided sums."""
    firsts = shared.select("lang", "n", "vector", F.posexplode("vector").alias("i", "x"))
    pairs = firsts.select("lang", "n", "x", F.explode(F.slice("vector", F.col("i") + 2, F.size("vector"))).alias("y"))
    off = lambda a, b: F.abs(F.col(f"x.{a}") - F.col(f"y.{b}"))
    beyond = off("p", "p") - off("p", "zero") - off("zero", "p") + off("zero", "zero")
    return pairs.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.col("n") * beyond).alias("value"))


def _one_sided(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, a, b, value) for both orders of each pair, named a < b: the sum over terms as if only one of the two ever had a term.

    For a source and another's zero share z this is the sum of n * (|p - z| - |zero - z|) over the source's distinct shares p:
    running sums in their order, with the other sources' z between them. A source has as many rows here as it has distinct
    counts, under the root of twice its terms, and as its language has sources.
    """
    shares = entries.groupBy("lang", "source", "p").agg(F.sum("n").alias("n"))
    ours = shares.select("lang", "source", F.col("p").alias("at"), "n", (F.col("n") * F.col("p")).alias("np"), *[F.lit(None).cast(t).alias(c) for c, t in (("other", "string"), ("zero", "long"), ("n_terms", "long"))])
    others = known.select("lang", F.col("source").alias("other"), F.col("zero").alias("at"))
    asked = known.select("lang", "source", "zero", "n_terms").join(others, "lang").where("source <> other")
    asked = asked.select("lang", "source", "at", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("np"), "other", "zero", "n_terms")
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    summed = ours.unionByName(asked).select("*", *[F.sum(c).over(w).alias(f"{c}_{k}") for c in ("n", "np") for k, w in (("below", upto), ("all", whole))])
    z, apart = F.col("at"), F.abs(F.col("zero") - F.col("at"))
    value = 2 * (z * F.col("n_below") - F.col("np_below")) + F.col("np_all") - z * F.col("n_all") - F.col("n_all") * apart
    # what terms that neither has add is counted once, in the order of the pair
    base = F.when(F.col("source") < F.col("other"), F.col("n_terms") * apart).otherwise(0)
    return summed.where("other is not null").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (value + base).alias("value"))


def _ranked(found: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = found.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= most) if most else out).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each two sources of a language, and the terms a source has more of.

    Part pair: each other source of the language, by the sum of the differences of all kept terms' shares. Part term: terms of
    the group with a share over the language's, by the difference, up to top_terms. Ties rank by item. Each row is a document,
    repeated or not; nulls count as '', which is a language and a source as any other. A language without kept terms has pairs
    of value 0; a single source has none; an empty table gives no rows. Other columns are not read.
    """
    rows = cells(docs, text_col, lang_col, source_col)
    kept = materialize(vectors(rows, min_docs), "vectors")
    known = materialize(groups(rows, kept), "groups")
    at = ["lang", "source"]
    distinct = materialize(kept.groupBy("lang", "vector").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    priced = join_by_size(distinct.select("id", "lang", F.col("n").alias("times"), F.inline("vector")), known.select(*at, "total", "n_terms", "zero", "n_entries"), at, "n_entries")
    entries = materialize(priced.select("id", *at, F.col("times").alias("n"), share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"), "zero"), "entries")
    shared = entries.groupBy("id", "lang", "n").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("vector"))
    apart = _both(shared).unionByName(_one_sided(entries, known)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = apart.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    own = join_by_size(kept.select("lang", "term", F.col("total").alias("all"), F.inline("vector")), known.drop("zero"), at, "n_entries")
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("all"), F.col("lang_total"), F.col("n_terms"))
    terms = own.select(*at, F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term", top_terms))
