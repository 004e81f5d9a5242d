"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are put into one part. With a threshold for each part, the thresholds adding up to radius - parts + 1,
any two fingerprints within the radius are within the threshold of some part. The number of parts and the thresholds are
chosen by dynamic programming over the work that each part would give, estimated from counts over all fingerprints.
Fingerprints are probed by signatures (a part's bits, less as many of them as its threshold) and verified.

A signature that many fingerprints share is not expanded into pairs. Its fingerprints differ in the other bits alone, so
each is listed under every fingerprint up to half the radius away in such bits: two within the radius meet there, and all
that meet are within it.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, materialize
from .components import components
from .election import elect, numbered, with_key

BITS, RADIUS, SEED = 64, 2, 42
#: The largest radius: half of it is how far the fingerprints of a frequent signature are listed around.
MOST = 4
#: Fingerprints that share a signature up to which they are compared in pairs; above it they are met half-way.
DENSE = 32


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """Hashes of all shingles, in order; of all words as one shingle where they are fewer than size."""
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(text[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(words: list[bytes], size: int = 3, seed: int = SEED) -> int:
    """Majority bits of the hashes of all shingles; zero without words. Signed, as Spark's long."""
    return majority(shingle_hashes(words, size, seed)) if words else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as Spark's long."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: Column, size: int = 3, seed: int = SEED) -> Column:
    """Fingerprint of a whole text as a long. A-Z count as a-z; a null text counts as empty and gives zero."""

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint((t or "").encode().lower().split(), size, seed) for t in texts.to_pylist()], pa.int64())

    return bits(text.cast("string"))


def _together(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and in how many each two bits are both set: 4096 sums, whatever the input."""

    def partial(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for i in range(0, len(x), 1 << 14):
                m = np.unpackbits(x[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (m.T @ m).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array([*range(BITS * BITS), -1], pa.int32()), "n": pa.array([*total.ravel().tolist(), n], pa.int64())})

    rows = prints.select("fp").mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    got = dict(rows)
    return int(got.get(-1, 0)), np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of near equal size; each group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts, 0, -1):
        size = -(-len(left) // k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: corr[b, rest].max())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].mean()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts, adding up to total at the least cost, by dynamic programming over parts and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picked) in best.items():
            for t, more in own.items():
                if s + t not in new or c + more < new[s + t][0]:
                    new[s + t] = (c + more, [*picked, t])
        best = new
    return best[total]


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _symmetric(values: list[float], k: int) -> float:
    """The sum over all choices of k values of their products."""
    sums = [1.0, *[0.0] * k]
    for v in values:
        for i in range(k, 0, -1):
            sums[i] += sums[i - 1] * v
    return sums[k]


def plan(prints: DataFrame, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Signatures as (mask, index of part), chosen over all fingerprints."""
    n, both = _together(prints)
    if not n:
        return []
    p = np.diag(both) / n
    agree = p * p + (1 - p) ** 2
    # thresholds of 2 at most
    layouts = {m: group_bits(n, both, m) for m in range(max(1, ceil((radius + 1) / 3)), radius + 2)}
    masks = [(m, k, _mask(g)) for m, gs in layouts.items() for k, g in enumerate(gs)]
    each = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for i, (_, _, x) in enumerate(masks)])).alias("s"))
    c = F.col("count").cast("double")
    sums = dict(each.groupBy("s.i", "s.v").count().groupBy("i").agg(F.sum(F.least(c * (c - 1) / 2, c * BITS))).collect())
    options = []
    for m, groups in layouts.items():
        cost = []
        for k, g in enumerate(groups):
            pairs = sums[masks.index((m, k, _mask(g)))]
            own = [1 / agree[b] for b in g]
            cost.append({-1: 0.0} | {t: n * comb(len(g), t) + pairs * _symmetric(own, t) for t in range(3)})
        options.append((*allocate(cost, radius - m + 1), m))
    _, thresholds, m = min(options)
    return [(_mask([x for x in g if x not in left]), k) for k, (g, t) in enumerate(zip(layouts[m], thresholds, strict=True)) if t >= 0 for left in combinations(g, t)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that connect all those within the radius, 0 to MOST.

    prints has one row for each fingerprint. Among few that share a signature every link is there; among many, links to the
    smallest of those that meet, which connect the same fingerprints.
    """
    if not 0 <= radius <= MOST:
        raise ValueError(f"the radius is 0 to {MOST}")
    masks = [m for m, _ in plan(prints, radius)] or [-1]
    signed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("sig", "key"))
    shared = signed.groupBy("sig", "key").agg(F.count("*").alias("n")).where("n > 1")
    near = materialize(signed.join(shared, ["sig", "key"]), "signatures")
    few = near.where(F.col("n") <= DENSE)
    x, y = few.select("sig", "key", F.col("fp").alias("a")), few.select("sig", "key", F.col("fp").alias("b"))
    pairs = x.join(y, ["sig", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    free = F.bitwise_not(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("sig") + 1))
    bits = F.filter(F.array(*[F.lit(_mask([b])) for b in range(BITS)]), lambda s: s.bitwiseAND(free) == s)
    # all ways to change up to half of the radius, rounded up; those that change no more than half of it, rounded down, are near
    ways, half = F.array(F.lit(0).cast("long")), (radius + 1) // 2
    for _ in range(half):
        ways = F.array_distinct(F.concat(ways, F.flatten(F.transform(ways, lambda w: F.transform(bits, lambda s: w.bitwiseOR(s))))))
    dense = near.where(F.col("n") > DENSE).select("fp", F.explode(ways).alias("way")).select("fp", F.col("fp").bitwiseXOR(F.col("way")).alias("centre"), (F.bit_count("way") <= radius // 2).alias("near")).distinct()
    dense = materialize(dense, "listed")
    middle = dense.groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("m"), F.count("*").alias("n")).where("m is not null and n > 1")
    stars = join_by_size(dense, materialize(middle, "centres"), ["centre"], "n").where(F.col("m") != F.col("fp")).select(F.least("m", "fp").alias("a"), F.greatest("m", "fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row a document: id_col, fp (long), component_id, the smallest id that links within the radius reach.

    Fingerprints are of shingles of size words; the radius is 0 to MOST. Null and empty texts have fingerprint zero and are
    linked like any other. Rows with equal texts and equal ids stay rows of their own. A component of null ids alone has a null
    component_id. An empty table gives no rows. Columns of docs other than the two are not read.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), size).alias("fp")), "prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "firsts")
    nodes = components(links(firsts.select("fp"), radius))
    known = nodes.join(firsts, nodes.node == firsts.fp).select("node", "root", "first")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    found = join_by_size(known, materialize(least, "roots"), ["root"], "n").select(F.col("node").alias("fp"), "component_id")
    of = firsts.join(found, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first").alias("component_id"))
    return join_by_size(prints, materialize(of, "classes"), ["fp"], "copies").select(F.col("id").alias(id_col), "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near-duplicates, as elect() chooses it. Columns stay as they are."""
    plain, (id_col, text_col) = numbered(docs, id_col, text_col)
    keyed = with_key(plain, id_col, text_col)
    groups = near_duplicates(keyed, "_key", text_col, size, radius).select("_key", F.col("component_id").alias("_group"))
    return elect(keyed, groups, id_col, text_col).toDF(*docs.columns)
