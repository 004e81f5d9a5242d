"""The audit of sources against plain sums over all terms and pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from bracketry.llm import divergence, op13
from bracketry.llm.divergence import audit, vectors

ROWS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain(rows, min_docs, top):
    docs = [(la or "", s or "", TERM.findall(lower(t or ""))) for _, t, la, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for la, s, ts in docs:
            if la == lang:
                counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in counts:
            pairs = [(sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(share(counts[s], t) - share(whole, t), t) for t in kept if counts[s][t] and share(counts[s], t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def made(seed, n, words, sources):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choice([*sources, sources[0], sources[0]])
        text = " ".join(rnd.choice(words) + rnd.choice(["", ",", "1", "-"]) for _ in range(rnd.choice([0, 3, 12])))
        rows.append((i, rnd.choice([text, text, text, None]), rnd.choice(["en", "de", None]), s))
    return rows


def test_all_terms_and_pairs(spark):
    """Few and many sources, terms that some lack, equal vectors, ties, letters beyond A-Z, nulls and repeated rows."""
    words = ["The", "the", "élan", "Élan", "a", "b", "zz", "ж", "퟿", "\U0001f600", "only", *[f"w{chr(97 + i)}" for i in range(20)]]
    for seed, sources, low in ((1, ["x", "y", None], 3), (2, [f"s{i}" for i in range(12)] + ["ß", "\U0001f600"], 8)):
        rows = made(seed, 240, words, sources)
        rows += rows[:5] + [(None, "solo " * 9, "solo", "x"), (7, None, "none", "x"), (7, "", "none", "y")]
        d = spark.createDataFrame(rows, ROWS)
        d = d.withColumns({c: F.lit(1) for c in ("n", "total", "vector", "id", "zero", "p", "item", "value", "rank", "part", "term")})
        got = [tuple(r) for r in audit(d, min_docs=low, top_terms=7).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, low, 7)
    assert audit(d.limit(0)).count() == 0


def test_equal_vectors_are_met_once(spark):
    rows = [(i, " ".join(f"t{chr(97 + k)}" for k in range(20)), "en", f"s{i % 2}") for i in range(40)]
    v = vectors(spark.createDataFrame(rows, ROWS).select("text", "lang", "source"))
    assert v.count() == 20 and v.select("vector").distinct().count() == 1


def test_stretches_add_up(monkeypatch):
    rows = [(r[2] or "", r[3] or "", r[1] or "") for r in made(4, 90, ["The", "the", "élan", "b", "\U0001f600"], ["x", "y"])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "source", "text"]).slice(3)
    want, docs = Counter(), Counter()
    for la, s, t in rows[3:]:
        want.update((la, s, w) for w in TERM.findall(lower(t)))
        docs.update({(la, s, w) for w in TERM.findall(lower(t))})
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(divergence, "STRETCH", size)
        n, d = Counter(), Counter()
        for out in divergence.count_terms([batch]):
            for r in out.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                d[r["lang"], r["source"], r["term"]] += r["n_docs"]
        assert (n, d) == (want, docs)


def test_shares_of_very_large_counts(spark):
    from bracketry.llm.divergence import share

    n, total, v = 10**13, 3 * 10**14 + 7, 10**6
    got = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_query_and_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{d}/documents.parquet'")
    df = op13.op13_source_audit(spark, d)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({op13.SQL})").fetchall())
