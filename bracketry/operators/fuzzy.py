"""Joins of names that are not quite equal: candidates by equal blocks, exact scores after, one answer or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import stored


def near_days(left: DataFrame, right: DataFrame, day: str, other: str, days: int) -> DataFrame:
    """Rows of both that are at most so many days apart: left stands under every day it may meet, so that days are joined as equal."""
    around = left.withColumn("_at", F.explode(F.sequence(F.date_sub(F.col(day), days), F.date_add(F.col(day), days))))
    return around.join(right, F.col("_at") == F.col(other)).drop("_at")


def pair_scores(a: Column, b: Column, x: Column, y: Column, score=T.edit_ratio) -> Column:
    """Columns mean, weaker, product and turned of two pairs of names, the better of both orientations by the mean.

    A generator, so that each of the four scores is worked out once, whatever reads the columns.
    """

    def of(s: Column, p: str, q: str, turned: bool) -> Column:
        return F.struct(((s[p] + s[q]) / 2).alias("mean"), F.least(s[p], s[q]).alias("weaker"), (s[p] * s[q]).alias("product"), F.lit(turned).alias("turned"))

    four = F.array(F.struct(score(a, x).alias("p"), score(b, y).alias("q"), score(a, y).alias("r"), score(b, x).alias("s")))
    better = lambda s: F.when(s["p"] + s["q"] >= s["r"] + s["s"], of(s, "p", "q", False)).otherwise(of(s, "r", "s", True))
    return F.inline(F.transform(four, better))


def best(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first candidate of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def only(df: DataFrame, key: str) -> DataFrame:
    """The candidates of keys that have no other."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def first_of(rows: DataFrame, key: Column, lookups: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """rows with found and by: the value of the first lookup (name, key of the row, table (k, v)) that has one."""
    out = rows
    for i, (_, own, values) in enumerate(lookups):
        out = out.join(values.select(F.col("k").alias(f"_k{i}"), F.col("v").alias(f"_v{i}")), own == F.col(f"_k{i}"), "left")
    found = F.coalesce(*[F.col(f"_v{i}") for i in range(len(lookups))])
    by = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), name) for i, (name, _, _) in enumerate(lookups)])
    return out.select(*rows.columns, found.alias("found"), by.alias("by"))


def may_be_alike(rows: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of rows (id, g): all pairs of sets above the threshold, and few others.

    Sets of n and m grams that are so alike differ in d = (1 - t) / (1 + t) (n + m) grams at most. Grams are dealt into d + 1 parts
    by their hash, so that the two sets agree in one part at least, and rows meet by the whole of a part: that is much rarer than
    one gram in common. d is that of a class of sizes; a row stands under its own class and the next one, so that sizes that may
    be alike meet. Where rows meet, the parities of 128 bits are a lower bound of the difference.
    """
    apart, least = (1 - threshold) / (1 + threshold), [1]
    while least[-1] < 1 << 31:
        least.append(int(least[-1] / threshold + 1e-9) + 1)
    parts = F.array(*[F.lit(int(apart * 2 * (n - 1) + 1e-9) + 1) for n in least[1:]])
    hashed = rows.select("id", F.size("g").alias("n"), F.array_sort(F.transform("g", lambda x: F.xxhash64(x))).alias("h"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    odd = lambda half: F.aggregate(F.filter("h", lambda x: x.bitwiseAND(64) == half), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))
    own = F.size(F.filter(F.array(*map(F.lit, least[:-1])), lambda x: x <= F.col("n"))) - 1
    placed = hashed.select("id", "n", "h", odd(0).alias("u"), odd(64).alias("v"), F.posexplode(F.array(own, own + 1)).alias("next", "size"))
    each = placed.select("*", F.get(parts, F.col("size")).alias("in")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("in") - 1)))
    # the part's number is of bits that the parities do not take
    part = F.filter("h", lambda x: F.pmod(F.shiftrightunsigned(x, 8), F.col("in")) == F.col("p"))
    signed = each.select("id", "n", "u", "v", "next", F.xxhash64("size", "p", part).alias("x"))
    a, b = (signed.select("x", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "u", "v", "next")]) for s in ("a", "b"))
    least_apart = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("u", "v"))
    near = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (least_apart <= apart * (F.col("n_a") + F.col("n_b")) + 1e-9)
    return a.join(b, "x").where((F.col("id_a") < F.col("id_b")) & ((F.col("next_a") == 0) | (F.col("next_b") == 0)) & near).select("id_a", "id_b").distinct()


def similar(df: DataFrame, key: str, grams: Column, threshold: float, block: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all rows whose sets of grams have a Jaccard similarity above the threshold, 0 < threshold < 1."""
    rows = stored(df.select(F.col(key).alias("k"), grams.alias("g")).where(F.size("g") > 0).withColumn("id", F.monotonically_increasing_id()))
    met = may_be_alike(rows, threshold)
    of = lambda s: rows.select(F.col("id").alias(f"id_{s}"), F.col("k").alias(f"k{s}"), F.col("g").alias(f"g{s}"))
    told = met.join(of("a"), "id_a").join(of("b"), "id_b").where("ka <> kb").withColumn("similarity", T.jaccard(F.col("ga"), F.col("gb"))).where(F.col("similarity") > threshold)
    return told.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
