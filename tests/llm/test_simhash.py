"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from bracketry.llm import simhash as S
from bracketry.llm.components import components
from bracketry.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values: dict, radius: int = 2) -> dict:
    """Smallest key that each key reaches over values of at most so many differing bits."""
    up = {k: k for k in values}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "one", "One TWO", "a b c", "a b c d a b c", "É é É", "x\ty\nz\x0bw", "a b c", "word " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode().lower().split()) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize(("seed", "radius"), [(0, 2), (1, 2), (2, 0), (3, 1), (4, 3), (5, 4)])
def test_links_connect_what_all_pairs_connect(spark, seed, radius):
    r = random.Random(seed)
    prints = set()
    for _ in range(40):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.choice([0, 1, 5])):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4, 5]))))
    centre = r.getrandbits(64)  # a dense group: signatures that more than DENSE share
    near = [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in r.sample(range(64), 3) if a != b]
    prints |= set(near) | {centre ^ 0b11111}
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    pairs = S.links(table, radius)
    assert pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > radius).count() == 0
    got = dict(components(pairs).collect())
    ours = {signed(x): got.get(signed(x), signed(x)) for x in prints}
    theirs = classes({signed(x): x for x in prints}, radius)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(ours) == groups(theirs)


def test_a_radius_beyond_the_most(spark):
    with pytest.raises(ValueError, match="radius"):
        S.links(spark.createDataFrame([(1,)], "fp long"), S.MOST + 1)


def test_sums_of_products():
    from itertools import combinations
    from math import prod

    for k in range(4):
        assert S._symmetric([1.5, 2.0, 3.0, 0.5], k) == pytest.approx(sum(prod(c) for c in combinations([1.5, 2.0, 3.0, 0.5], k)))


def test_groups_of_bits_partition_them():
    import numpy as np

    r = np.random.default_rng(0)
    bits = r.integers(0, 2, (500, 64)).astype(float)
    bits[:, 7] = bits[:, 40]
    both = bits.T @ bits
    for m in (2, 3):
        groups = S.group_bits(500, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert any({7, 40} <= set(g) for g in groups)


def test_allocation_is_the_cheapest():
    from itertools import product

    cost = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 2.0, 1: 30.0}, {-1: 0.0, 0: 4.0, 1: 5.0}]
    for total in (-1, 0, 1):
        best = min(sum(c[t] for c, t in zip(cost, ts, strict=True)) for ts in product((-1, 0, 1), repeat=3) if sum(ts) == total)
        found, ts = S.allocate(cost, total)
        assert (found, sum(ts)) == (best, total)


def test_edge_rows(spark):
    long_ = "many words in a row " * 20_000
    rows = [(4, None, "x", 1), (2, "", "y", 2), (9, " \t ", None, 3), (7, "a b c d e", "z", 4), (7, "a b c d e", "z", 4), (None, "A B C D E", "z", 5), (8, long_, "q", 6), (3, long_, "q", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == [(False, 2, 2), (False, 3, 3), (False, 4, 2), (False, 7, 7), (False, 7, 7), (False, 8, 3), (False, 9, 2), (True, 0, 7)]
    kept = S.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) in ([2, 3], [2, 3, 7])
    assert kept.count() == 3
    assert S.near_duplicates(docs.where("false")).count() == 0
    assert S.survivors(docs.where("false")).count() == 0


def test_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c d e f")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(docs).collect()] == [None, None]


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = classes(prints)
    got = QUERIES["op5_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 102), (102, 100)], [(None, 4), (5, 6)]])
def test_components(spark, edges):
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = {}

    def root(k):
        up.setdefault(k, k)
        return k if up[k] == k else root(up[k])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {k: root(k) for k in up}


def test_survivors_keep_texts_of_null_and_equal_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (5, text("a")), (9, text("b")), (7, text("d")), (7, text("e")), (7, text("e")), (8, text("d")), (None, None), (None, "")]
    kept = S.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (None, None)])
