"""Near-duplicates of the pipeline against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from bracketry.llm import similar as M
from bracketry.llm.simhash import fingerprint


def shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(rows: list[tuple]) -> set:
    """Smallest ids of the groups that all pairs connect."""
    up, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if up[i] != up[j] and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (len(x & y) >= 0.8 * len(x | y)):
                old, new = up[i], up[j]
                up = [new if u == old else u for u in up]
    return {min(d for (d, _), u in zip(rows, up, strict=True) if u == g) for g in set(up)}


@pytest.mark.parametrize("frequent", [1, 3])
def test_edited_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(M, "FREQUENT", frequent)
    r = random.Random(7)
    line = " ".join(f"common{i}" for i in range(12))
    rows = [(k, f"{line} " + " ".join(f"d{k}w{i}" for i in range(r.choice([6, 40, 150])))) for k in range(30)]
    for k in range(30):
        for _ in range(3):
            words = rows[k][1].split()
            for _ in range(r.choice([0, 1, 2, 4])):
                words[r.randrange(len(words))] = f"edit{r.random()}"
            rows.append((len(rows), " ".join(words)))
    base = [f"g{i}" for i in range(100)]  # a large group, some of which meet by others alone
    for k in range(60):
        at = r.randrange(90)
        rows.append((len(rows), " ".join([*base[:at], f"new{k}", *base[at + r.randrange(9) :]])))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one TWO"), (905, "one three")]
    edited = [(a, b) for a in range(30) for b in range(30, 120) if 0.8 <= similarity(rows[a][1], rows[b][1]) < 0.95]
    assert any((fingerprint(rows[a][1].encode().split()) ^ fingerprint(rows[b][1].encode().split())) & (2**64 - 1) and ((fingerprint(rows[a][1].encode().split()) ^ fingerprint(rows[b][1].encode().split())) & (2**64 - 1)).bit_count() > 2 for a, b in edited)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {d.doc_id for d in P.drop_near_duplicates(spark, docs, "").collect()} == kept(rows)


def test_beginnings_reach_the_least_similarity():
    for a in range(1, 300):
        for b in range(a, 400):
            m = next((m for m in range(a + 1) if 10 * m >= 8 * (a + b - m)), None)
            if m is not None:
                assert m >= M._needed(a) and m >= M._needed(b)


def test_an_empty_table(spark):
    assert P.drop_near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_parities_never_differ_more_than_sets():
    r = random.Random(2)
    for n in (1, 5, 400, 3000):
        a = {r.getrandbits(63) for _ in range(n)}
        b = set(r.sample(sorted(a), n * 9 // 10)) | {r.getrandbits(63) for _ in range(n // 9)}
        x, y = (M.parities(M.np.array(sorted(s), "<i8")).view("<u8") for s in (a, b))
        assert sum(int(d).bit_count() for d in x ^ y) <= len(a ^ b)
