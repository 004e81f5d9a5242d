"""The language model: base score by plain counting, probabilities that add up, and held-out text it predicts better."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bracketry.llm import lm
from bracketry.llm.common import crc_mod
from bracketry.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_tokens(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [*(w for w in low.split(" ") if w), lm.END]


def brute(docs: list[tuple]) -> list[tuple]:
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(t for d, text in docs if not held(d) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in docs:
        own = plain_tokens(text)
        out.append((d, held(d), len(own), sum(1 for t in own if counts[t]), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op4_lm_score"](spark, SMALL).collect(), brute(docs))


def test_rare_tokens_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op4_lm_score"](spark, SMALL).collect(), brute(docs))


def test_held_out_text_is_predicted_better_than_by_counts(spark):
    rows = [r for r in QUERIES["op4_lm_score"](spark, MIDDLE).collect() if r.held_out]
    assert len(rows) > 50
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def fitted(spark, docs, monkeypatch):
    """Scores of docs with what train() gave."""
    seen, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda known, v: seen.append((v, train(known, v))) or seen[-1][1])
    rows = lm.score(docs).collect()
    return rows, *seen[0]


def test_scores_against_plain_probabilities(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    texts = dict(docs.collect())
    rows, v, p = fitted(spark, spark.createDataFrame(list(texts.items()), docs.schema), monkeypatch)
    train = Counter(t for d, text in texts.items() if zlib.crc32(str(d).encode()) % 10 for t in plain_tokens(text))
    own = [t.decode() for t, i in v.index.items() if v.unit[i] < v.own]
    klass = lambda t: zlib.crc32(t.encode()[:3]) % lm.CLASSES
    size, once = Counter(), Counter()
    for t, c in train.items():
        if t not in own:
            size[klass(t)] += c
            once[klass(t)] += c == 1
    place = {t: i for i, t in enumerate(own)}

    def unit(t):
        return place.get(t, v.own + klass(t))

    def plain(text):
        total, one, two = 0.0, 0, 0
        for t in plain_tokens(text):
            s = ((p.position[0] * p.context[one] + p.position[1] * p.context[two]) @ p.target.T + p.bias).astype(float)
            total += s[unit(t)] - np.log(np.exp(s - s.max()).sum()) - s.max()
            if t not in place:
                k = klass(t)
                unseen = (once[k] + 0.5) / (size[k] + 1) if size[k] else 1.0
                total += math.log((1 - unseen) * train[t] / size[k] if train[t] else unseen)
            one, two = unit(t), one
        return total / math.log(10)

    assert len(rows) == len(texts)
    for r in rows[:40]:
        assert r.score == pytest.approx(plain(texts[r.doc_id]), rel=1e-4)


def test_partitions_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in lm.score(docs.repartition(n)).collect()} for n in (1, 8))
    assert many == pytest.approx(one, rel=1e-6)


def test_probabilities_add_up(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where(crc_mod(lm.F.col("doc_id"), 10) != 0)
    _, v, p = fitted(spark, docs, monkeypatch)
    z = lm.normalisers(spark, p)
    for one, two in ((0, 0), (3, 7), (v.own + 12, v.own - 1)):
        s = (p.position[0] * p.context[one] + p.position[1] * p.context[two]) @ p.target.T + p.bias - z[two, one]
        assert np.exp(s.astype(float)).sum() == pytest.approx(1, abs=1e-4)
        # every known token, and in each class the one type that training lacks
        unit = np.exp(s.astype(float))
        inside = np.where(v.unit < v.own, 0.0, v.share(v.count, np.maximum(v.unit - v.own, 0)))
        known = (unit[v.unit] * 10**inside).sum()
        unknown = (unit[v.own :] * v.class_unknown).sum()
        assert known + unknown == pytest.approx(1, abs=0.01)


def test_edge_rows(spark):
    rows = [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "a b c", "x", 1.0), (3, "a b c", "x", 1.0), (None, "A B", "x", 1.0), (16, "unseen words", "x", 1.0), (5, "long " * 50_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string, score double")
    same(lm.score(docs).collect(), brute([r[:2] for r in rows]))
    assert lm.score(docs.where("false")).count() == 0
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    alone = lm.score(spark.createDataFrame([(held, "no training text")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in alone] == [(True, 4, 0, 0)]
