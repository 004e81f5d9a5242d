"""Evaluation of forecasts: scores, calibration, intervals, splits and resampling, all as grouped aggregations."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import stored
from .scan import sums_before

EPS = 1e-4


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def scores(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, log_loss, brier and n, over all rows or by group."""
    P, Y = F.col(p), F.col(y)
    hit = F.when((P >= 0.5) == (Y == 1), 1.0).otherwise(0.0)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss(P, Y)).alias("log_loss"), F.avg((P - Y) * (P - Y)).alias("brier"))


def auc(df: DataFrame, p: str, y: str, by: str) -> DataFrame:
    """Area under the curve by group from rank sums; tied scores share their mean rank.

    Equal scores are counted first; running sums over the different ones are by ranges, so that a group may have any number.
    """
    tied = df.groupBy(by, p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    ranked = sums_before(tied, [by], [p], ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return sums.select(by, F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def bins(p: Column, n: int = 10) -> Column:
    """Equal bins, the last one closed."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def calibration(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate)."""
    return df.groupBy(bins(F.col(p), n).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def murphy(df: DataFrame, p: str, y: str) -> DataFrame:
    """reliability, resolution and uncertainty; their first less second plus third is the binned Brier score."""
    cells = calibration(df, p, y).withColumn("hits", F.col("n") * F.col("rate"))
    total = cells.agg(F.sum("n").alias("total"), (F.sum("hits") / F.sum("n")).alias("base"))
    gaps = cells.crossJoin(F.broadcast(total))
    return gaps.groupBy("base").agg((F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("rate"), 2)) / F.sum("n")).alias("reliability"), (F.sum(F.col("n") * F.pow(F.col("rate") - F.col("base"), 2)) / F.sum("n")).alias("resolution")).select("reliability", "resolution", (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def expected_error(df: DataFrame, p: str, y: str) -> DataFrame:
    return calibration(df, p, y).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct<lo, hi>."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct((mid - half).alias("lo"), (mid + half).alias("hi"))


def walk_forward(df: DataFrame, day: str, origins: DataFrame, origin: str, val_days: int, test_days: int) -> DataFrame:
    """Every row under every origin it belongs to, as train, val or test. Origins are a short calendar."""
    t, o = F.to_date(day), F.col(origin)
    role = F.when(t < F.date_sub(o, val_days), "train").when(t < o, "val").when(t < F.date_add(o, test_days), "test")
    return df.crossJoin(F.broadcast(origins)).withColumn("role", role).where(F.col("role").isNotNull())


def bootstrap(df: DataFrame, unit: str, value: str, replicates: int, seed: int = 11) -> DataFrame:
    """Percentile interval of a mean with whole units drawn: each unit has a Poisson(1) count in each replicate, by hash."""
    sums = df.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(unit), F.col("rep")), F.lit(1 << 30)) / float(1 << 30)
    cut, term, times = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):
        cut += term
        term /= k
        times = times + F.when(u >= cut, 1).otherwise(0)
    means = drawn.withColumn("w", times).groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def ridge(df: DataFrame, target: str, features: list[str], penalty: float) -> dict[str, float]:
    """Coefficients with an intercept: sums of products by Spark, a system of a few equations on the driver."""
    names = ["1", *features]
    cols = {"1": F.lit(1.0), **{f: F.col(f).cast("double") for f in features}, "y": F.col(target).cast("double")}
    pairs = [(a, b) for i, a in enumerate([*names, "y"]) for b in [*names, "y"][i:]]
    row = df.agg(*[F.sum(cols[a] * cols[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
    got = {p: row[i] for i, p in enumerate(pairs)}
    at = lambda a, b: got.get((a, b), got.get((b, a)))
    gram = np.array([[at(a, b) for b in names] for a in names], float) + penalty * np.diag([0.0, *[1.0] * len(features)])
    return dict(zip(names, np.linalg.solve(gram, np.array([at(a, "y") for a in names], float)).tolist(), strict=True))


def average_ranks(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with the rank of value in its group, equal values sharing their mean rank. Null values have none."""
    tied = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    ranks = sums_before(tied, [by], [value], ["_n"]).select(F.col(by).alias("_by"), F.col(value).alias("_v"), (F.col("before__n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[by].eqNullSafe(F.col("_by")) & (df[value] == F.col("_v")), "left").drop("_by", "_v")


#: Different values of y up to which they go to all tasks.
HELD = 1_000_000


def shuffled(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each place of 0 to n - 1 goes in the seed's permutation: rounds of a keyed network, again for what leaves the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 6, dtype=np.uint64)
    out = place.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x = out[left]
        hi, lo = x >> np.uint64(half), x & mask
        for k in keys:
            z = (lo + k) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            hi, lo = lo, hi ^ ((z ^ (z >> np.uint64(32))) & mask)
        out[left] = (hi << np.uint64(half)) | lo
        left = left[out[left] >= n]
    return out.astype(np.int64)


def permutation(df: DataFrame, key: str, by: str, x: str, y: str, replicates: int, seed: int = 5, spearman: bool = False) -> DataFrame:
    """(observed, p): a statistic of x and y, and the share of replicates that reach it with y dealt anew within groups.

    The statistic is the mean product, counted where it is reached or passed; with spearman the correlation of the ranks within
    each group, counted where its size is. Rows with a null x or y are left out. Each row gets a place in its group once; a
    replicate is a keyed permutation of places, and the y that lies at a place follows from the counts of the different values
    of y, which all tasks hold. No row moves for a replicate. There may be HELD different values of y in a group at most, or y
    must have no ties and be ranked, when a place is its rank; other data are an error.
    """
    rows = df.select(F.col(key).alias("key"), F.col(by).alias("by"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    if spearman:
        rows = average_ranks(average_ranks(rows, "by", "x", "_rx"), "by", "y", "_ry").select("key", "by", F.col("_rx").alias("x"), F.col("_ry").alias("y"))
    rows = stored(rows.withColumns({"h": F.xxhash64(F.lit(seed), "key"), "one": F.lit(1).cast("long")}))
    placed = sums_before(rows, ["by"], ["h", "key"], ["one"]).select("by", "x", "y", F.col("before_one").alias("place"))
    values = stored(sums_before(rows.groupBy("by", "y").agg(F.count("*").alias("n")), ["by"], ["y"], ["n"]))
    sizes = {r["by"]: (r["n"], r["k"]) for r in values.groupBy("by").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    ranks = spearman and all(n == k for n, k in sizes.values())
    if not ranks and sum(k for _, k in sizes.values()) > HELD:
        raise ValueError(f"y has more than {HELD} different values and ties")
    tables: dict = {}
    if not ranks:
        for r in values.orderBy("by", "y").select("by", "before_n", "y").collect():
            tables.setdefault(r["by"], ([], []))[0].append(r["before_n"])
            tables[r["by"]][1].append(r["y"])
    held = df.sparkSession.sparkContext.broadcast({k: (np.array(a), np.array(b)) for k, (a, b) in tables.items()})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            groups, xs, ys, places = (b.column(c).to_pylist() if c == "by" else b.column(c).to_numpy(zero_copy_only=False) for c in ("by", "x", "y", "place"))
            at: dict = {}
            for i, g in enumerate(groups):
                at.setdefault(g, []).append(i)
            for g, i in at.items():
                total = sums.setdefault(g, np.zeros(replicates + 1))
                total[0] += float(xs[i] @ ys[i])
                for rep in range(1, replicates + 1):
                    to = shuffled(places[i], sizes[g][0], seed * 1_000_003 + rep)
                    own = to + 1.0 if ranks else held.value[g][1][np.searchsorted(held.value[g][0], to, side="right") - 1]
                    total[rep] += float(xs[i] @ own)
        for g, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(total), kind), pa.array(range(len(total)), pa.int32()), pa.array(total)], ["by", "rep", "s"])

    kind = to_arrow_schema(placed.select("by").schema).field("by").type
    sums = placed.mapInArrow(dealt, placed.select("by", F.lit(0).alias("rep"), F.lit(0.0).alias("s")).schema).groupBy("by", "rep").agg(F.sum("s").alias("s"))
    if spearman:
        m = rows.groupBy("by").agg(F.count("*").alias("n"), F.sum("x").alias("mx"), F.sum("y").alias("my"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
        centred = lambda a, b, c: F.col(a) - F.col(b) * F.col(c) / F.col("n")
        size = F.sqrt(centred("xx", "mx", "mx") * centred("yy", "my", "my"))
        per = sums.join(m.withColumnRenamed("by", "_by"), F.col("by").eqNullSafe(F.col("_by"))).select("rep", "n", F.coalesce(F.try_divide(centred("s", "mx", "my"), size), F.lit(0.0)).alias("v"))
        means = per.groupBy("rep").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
        reached = F.abs("m") >= F.abs("observed") - 1e-12
    else:
        n = sum(n for n, _ in sizes.values())
        means = sums.groupBy("rep").agg((F.sum("s") / n).alias("m"))
        reached = F.col("m") >= F.col("observed")
    observed = means.where("rep = 0").select(F.col("m").alias("observed"))
    return means.where("rep > 0").crossJoin(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(reached) + 1) / (F.count("*") + 1)).alias("p"))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring blocks (lo, hi, s, w) of a range made one as long as a mean is not over the one before it."""
    out: list[list[float]] = []
    for b in batches:
        for lo, hi, s, w in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "s", "w")), strict=True):
            block = [lo, hi, s, w]
            while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
                last = out.pop()
                block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
            out.append(block)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["lo", "hi", "s", "w"])


def isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """(boundary, value): the rising step function nearest to y: the ends of each step.

    Blocks of a range are pooled where they are, and again over ranges that are cut elsewhere, until no mean is below the one
    before it. Pooling in any order gives the one answer. Nulls are left out.
    """
    blocks = stored(df.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("y")).dropna().groupBy("lo").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("w")).select("lo", F.col("lo").alias("hi"), "s", "w"))
    n, ranges, mean = None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("s") / F.col("w")
    while True:
        pooled = blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInArrow(_pooled, "lo double, hi double, s double, w double")
        told = stored(pooled.withColumn("range", F.spark_partition_id()))
        blocks = told.drop("range")
        # a row a range: do the means rise from each range to the next?
        ends = sorted(told.groupBy("range").agg(F.min("lo"), F.min_by(mean, "lo"), F.max_by(mean, "lo"), F.count("*")).drop("range").collect())
        if all(a[2] < b[1] for a, b in itertools.pairwise(ends)):
            break
        # cut elsewhere; into fewer ranges where that has pooled nothing, as too few rows always have the same cuts
        left = sum(e[3] for e in ends)
        n, ranges = left, max(1, ranges // 2) if left == n else ranges + 1 if ranges % 2 == 0 else max(1, ranges - 1)
    value = F.col("s") / F.col("w")
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select(F.explode(ends).alias("boundary"), value.alias("value"))
