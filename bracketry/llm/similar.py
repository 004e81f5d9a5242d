"""Near-duplicates by SimHash and exact similarity: groups of texts whose sets of five-word shingles have a Jaccard similarity of
0.8 and more.

SimHash (simhash.links) proposes first: fingerprints of the sets within its radius are verified by all shingles and linked. A
similarity of 0.8 may be ten bits and more away, which no block index finds at a bearable cost, so that what is left is found
from the sets. Two sets of a and b shingles (a <= b) of this similarity share ceil(0.8 b) at least. With all shingles in one
order, such sets have a shingle in common among the first n - ceil(0.8 n) + 1 of each. These are listed; sets that meet in a list,
are not yet in one group, and whose parities leave the similarity open, are verified as well. Every pair that is alike meets,
whatever the order. The order puts shingles last that are frequent in a sample, which keeps lists short.

Long lists are not expanded into pairs at once: along with what SimHash proposes, each member is compared with one of its list,
which links large groups of near copies. After that only pairs of different groups are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import frugal, join_by_size, materialize
from .components import components
from .election import elect, numbered, with_key
from .simhash import majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Keys in the sample that orders shingles: at least so many, or one in so many; counts from which a shingle is frequent; how
#: many of these are sent to tasks. They change the length of lists alone.
SAMPLE, SAMPLE_SHARE, FREQUENT, SENT = 8_000, 50, 3, 1 << 18
PARITIES = 1024
#: Bits within which fingerprints are proposed.
RADIUS = 2


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; none without words. A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(words, SHINGLE)).view("<i8") if words else np.zeros(0, "<i8")


def parities(own: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether an odd number of the hashes fall on each. Sets differ in as many members as in bits, or more."""
    odd = np.bincount((own & (PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _needed(n: int) -> int:
    """The least integer of SIMILARITY * n and more."""
    return -(-8 * n // 10)


def _sets(texts: DataFrame) -> DataFrame:
    """(_key, own) of (_key, text)."""

    def sets(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["_key", "own"])

    return texts.mapInArrow(frugal(sets), "_key long, own array<long>")


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted, and their counts."""
    n = texts.count()
    every = max(1, n // max(SAMPLE, n // SAMPLE_SHARE))
    some = _sets(texts.where(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(every)) == 0))
    rows = some.select(F.explode("own").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(SENT).collect()
    found = np.array(sorted((h, c) for h, c in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def beginnings(texts: DataFrame) -> DataFrame:
    """(_key, s, n, fp, bits, first): the hash of the whole set, its size, its fingerprint, its parities and its first shingles in the common order."""
    often, counts = frequent(texts)

    def first(own: np.ndarray) -> np.ndarray:
        if len(often):
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            own = own[np.lexsort((own, np.where(often[at] == own, counts[at], 0)))]
        return own[: len(own) - _needed(len(own)) + 1] if len(own) else own

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                own = [shingle_set(t) for t in b.column(1).to_pylist()]
                s = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in own], np.uint64).view("<i8")
                cols = [b.column(0), pa.array(s), pa.array([len(x) for x in own], pa.int32()), pa.array([majority(x.view("<u8")) for x in own], pa.int64()), pa.array([parities(x) for x in own], pa.list_(pa.int64())), pa.array([first(x) for x in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "s", "n", "fp", "bits", "first"])

    return materialize(texts.mapInArrow(frugal(rows), "_key long, s long, n int, fp long, bits array<long>, first array<long>"), "beginnings")


def _alike(pairs: DataFrame, one: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those with enough shingles in common. one has a key, the size and the parities of each set."""
    of = lambda x: one.select(F.col("s").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("_key", "n", "bits")])
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    close = pairs.join(of("a"), "a").join(of("b"), "b").where(9 * differ <= F.col("a_n") + F.col("b_n")).select("a", "b", "a_n", "b_n", "a__key", "b__key")
    close = materialize(close, "close")
    keys = close.select(F.explode(F.array("a__key", "b__key")).alias("_key")).distinct()
    sets = materialize(_sets(texts.join(keys, "_key", "left_semi").dropDuplicates(["_key"])), "sets")
    x, y = sets.select(F.col("_key").alias("a__key"), F.col("own").alias("a_own")), sets.select(F.col("_key").alias("b__key"), F.col("own").alias("b_own"))
    m = F.size(F.array_intersect("a_own", "b_own"))
    return close.join(x, "a__key").join(y, "b__key").where(10 * m >= 8 * (F.col("a_n") + F.col("b_n") - m)).select("a", "b")


def proposed(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets by SimHash: sets of one fingerprint with the first of them, and the first ones of fingerprints within RADIUS."""
    prints = materialize(sketches.groupBy("fp").agg(F.min("s").alias("first"), F.count("*").alias("copies")), "prints")
    same = join_by_size(sketches.select("fp", "s"), prints, ["fp"], "copies").where("s <> first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    one, two = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in ("a", "b"))
    near = simhash.links(prints.select("fp"), RADIUS).join(one, "a").join(two, "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    return same.unionAll(near)


def links(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) for sets that are alike, by chains of those; sets like no other are not listed. found as of beginnings()."""
    sketches = materialize(found.groupBy("s").agg(F.min_by(F.struct("_key", "n", "fp", "bits"), "_key").alias("f")).select("s", "f.*"), "sketches")
    lists = found.select("s", "n", F.posexplode("first").alias("pos", "h")).select("s", "h", "n", (F.col("n") - F.col("pos")).alias("left"))
    shared = lists.groupBy("h").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("h")
    near = materialize(lists.join(shared, "h", "left_semi").distinct(), "lists")

    def met(now: DataFrame, other: DataFrame) -> DataFrame:
        # at the first shingle in common, all others in common are still to come
        meet = (F.col("a") != F.col("b")) & (18 * F.least("left", "other_left") >= 8 * (F.col("n") + F.col("other_n"))) & (F.col("root") != F.col("other_root"))
        other = other.select("h", F.col("s").alias("b"), F.col("n").alias("other_n"), F.col("left").alias("other_left"), F.col("root").alias("other_root"))
        return now.withColumnRenamed("s", "a").join(other, "h").where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # what SimHash proposes, and each member of a list with one of it
    now = near.withColumn("root", F.col("s"))
    middle = F.min_by(F.struct("s", "n", "left", "root"), F.struct(F.xxhash64("s"), "s")).alias("c")
    first = met(now, now.groupBy("h").agg(middle).select("h", "c.*")).unionAll(proposed(sketches)).distinct()
    edges = materialize(_alike(first, sketches, texts), "alike")
    known = materialize(components(edges), "known")
    # all pairs of a list that are not in one group by now
    now = near.join(known, F.col("s") == F.col("node"), "left").select(*near.columns, F.coalesce("root", "s").alias("root"))
    mixed = now.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    now = materialize(now.join(mixed, "h", "left_semi"), "mixed")
    edges = edges.unionAll(materialize(_alike(met(now, now).distinct(), sketches, texts), "alike"))
    return materialize(components(edges), "known")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, as elect() chooses it. Columns stay as they are.

    Texts without words are alike. Texts of fewer than five words are one shingle.
    """
    plain, (id_col, text_col) = numbered(docs, id_col, text_col)
    keyed = with_key(plain, id_col, text_col)
    texts = keyed.select("_key", F.col(text_col).cast("string"))
    found = beginnings(texts)
    known = links(found, texts)
    groups = found.select("_key", "s").join(known, F.col("s") == F.col("node"), "left").select("_key", F.coalesce("root", "s").alias("_group"))
    return elect(keyed, groups, id_col, text_col).toDF(*docs.columns)
