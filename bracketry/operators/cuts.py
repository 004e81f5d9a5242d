"""Two sides out of conflicts: nodes that may not be on one side, the sides of parts that share no conflict, and the direction
that differences point along.

The cut starts from the leading direction of the graph's Laplacian, by rounds of sums along edges, and goes on with flips. All
nodes whose flip gains most among their neighbours flip at once: no two of them are neighbours, so that each gain is whole and
the cut never falls. Components of up to WHOLE edges go in tasks, many of them in one, where all rounds are the same sums in
numpy; larger ones are cut by rounds of stored tables. Nothing but sums comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .graph import smallest_reachable, stored

#: Rounds of the power iteration; what a flip must gain, for its weight.
TURNS, LEAST_GAIN = 24, 1e-12
#: Edges, in both directions, of a component that is cut in one task, and of all components of a task, more or less.
WHOLE = 250_000


def conflicts(links: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """(x, y, w) in both directions with summed weights; null ends, ends that are equal and weights of 0 and less are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y"), w.alias("w")).where("x is not null and y is not null and x <> y and w > 0")
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w"))


def _gains(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component, label, gain): what the cut gains if the node alone changes sides."""
    of = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"_{n}"))
    own = edges.join(of("x"), "x").join(of("y"), "y").groupBy(F.col("x").alias("node")).agg(F.sum(F.when(F.col("_x") == F.col("_y"), F.col("w")).otherwise(-F.col("w"))).alias("gain"))
    return labels.join(own, "node")


def _cut_whole(turns: int):
    """Rows (component, x, y, w, v) of a task, whole components, to (node, component, label) as _cut_by_rounds has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        # numbers in the order of nodes: every node is an x
        nodes, first, x = np.unique(rows["x"].to_numpy(), return_index=True, return_inverse=True)
        y, w, n = np.searchsorted(nodes, rows["y"].to_numpy()), rows["w"].to_numpy(), len(nodes)
        component, lot = np.unique(rows["component"].to_numpy()[first], return_inverse=True)
        v, degree = rows["v"].to_numpy()[first], np.bincount(x, w, n)
        for _ in range(turns):
            v = degree * v - np.bincount(x, w * v[y], n)
            size = np.zeros(len(component))
            np.maximum.at(size, lot, np.abs(v))
            v = np.divide(v, size[lot], out=np.zeros(n), where=size[lot] > 0)
        label = (v > 0).astype(np.int32)
        while True:
            gain = np.bincount(x, np.where(label[x] == label[y], w, -w), n)
            flip = gain > LEAST_GAIN
            if not flip.any():
                break
            met = flip[x] & flip[y]
            beaten = met & ((gain[y] > gain[x]) | ((gain[y] == gain[x]) & (y > x)))
            flip[x[beaten]] = False
            label[flip] = 1 - label[flip]
        label ^= label[np.searchsorted(nodes, component)][lot]
        kinds = [rows.schema.field(c).type for c in ("x", "component")]
        yield from pa.table({"node": pa.array(nodes, kinds[0]), "component": pa.array(component[lot], kinds[1]), "label": pa.array(label, pa.int32())}).to_batches(max_chunksize=10_000)

    return cut


def max_cut(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """(node, component, label 0 or 1) of conflicts(): sides such that much of the weight is between them, and no one flip adds to it.

    A component is known by its smallest node, which is on side 0. A graph that can be parted without a conflict within a side
    is, wherever the rounds have told its parts apart; else the result is a local optimum.
    """
    edges = stored(edges)
    roots = smallest_reachable(edges, "x", "y").select("node", F.col("root").alias("component"))
    placed = stored(edges.join(roots.withColumnRenamed("node", "x"), "x"))
    large = stored(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("component"))
    apart = not large.isEmpty()
    some = placed.join(large, "component", "left_anti") if apart else placed
    dealt = some.select("component", "x", "y", "w", _start("x").alias("v")).repartition(max(1, -(-placed.count() // max(WHOLE, 1))), "component")
    kinds = dict(placed.dtypes)
    labels = stored(dealt.mapInArrow(_cut_whole(turns), f"node {kinds['x']}, component {kinds['component']}, label int"))
    if apart:
        rest = stored(placed.join(large, "component", "left_semi").select("x", "y", "w"))
        labels = labels.unionByName(_cut_by_rounds(rest, roots.join(large, "component", "left_semi"), turns))
    return labels


def _start(node: str) -> Column:
    """A start that is the same in every run and like no eigenvector."""
    return (F.pmod(F.xxhash64(node), F.lit(1 << 20)) - (1 << 19)).cast("double")


def _cut_by_rounds(edges: DataFrame, roots: DataFrame, turns: int) -> DataFrame:
    degrees = edges.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("degree"))
    now = stored(roots.join(degrees, "node").withColumn("v", _start("node")))
    for _ in range(turns):
        pulled = edges.join(now.select(F.col("node").alias("y"), "v"), "y").groupBy(F.col("x").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("p"))
        turned = now.join(pulled, "node").withColumn("v", F.col("degree") * F.col("v") - F.col("p")).drop("p")
        size = turned.groupBy("component").agg(F.max(F.abs("v")).alias("size"))
        now = stored(turned.join(size, "component").withColumn("v", F.coalesce(F.try_divide("v", "size"), F.lit(0.0))).drop("size"))
    labels = stored(now.select("node", "component", F.when(F.col("v") > 0, 1).otherwise(0).alias("label")))
    while True:
        gains = stored(_gains(edges, labels))
        willing = gains.where(F.col("gain") > LEAST_GAIN)
        if willing.isEmpty():
            break
        rank = lambda n: willing.select(F.col("node").alias(n), F.struct(F.col("gain"), F.col("node")).alias(f"_{n}"))
        beaten = edges.join(rank("x"), "x").join(rank("y"), "y").where("_y > _x").select(F.col("x").alias("node")).distinct()
        flips = willing.join(beaten, "node", "left_anti").select("node", F.lit(1).alias("flip"))
        labels = stored(labels.join(flips, "node", "left").select("node", "component", F.when(F.col("flip") == 1, 1 - F.col("label")).otherwise(F.col("label")).alias("label")))
    first = labels.where("node = component").select("component", F.col("label").alias("zero"))
    return labels.join(first, "component").select("node", "component", F.when(F.col("label") == F.col("zero"), 0).otherwise(1).alias("label"))


def frustration(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, nodes, total, within, frustration): the weight of all conflicts and of those within a side."""
    of = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"_{n}"), "component")
    met = edges.where("x < y").join(of("x"), "x").join(of("y").drop("component"), "y")
    sums = met.groupBy("component").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("_x") == F.col("_y"), F.col("w")).otherwise(0.0)).alias("within"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    return sizes.join(sums, "component").select("component", "nodes", "total", "within", (F.col("within") / F.col("total")).alias("frustration"))


def _mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    each = rows.select(*by, F.posexplode(vector).alias("i", "value")).groupBy(*by, "i").agg(F.avg("value").alias("value"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("mean"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def align(labels: DataFrame, signatures: DataFrame, by: list[str]) -> DataFrame:
    """labels (by, node, component, label) with each component's sides exchanged where that fits the largest component of its by better.

    signatures has (node, vector), all of one length. A side's signature is the mean of its nodes'; a component is turned if the
    products of unlike sides with the largest component's add up to more. Components without a signature on each side, and
    those of a by whose largest has none, stay. Of equally large components that of the smallest id leads.
    """
    sides = _mean_vectors(labels.join(signatures, "node"), [*by, "component", "label"], "vector")
    pair = sides.groupBy(*by, "component").agg(*[F.first(F.when(F.col("label") == k, F.col("mean")), ignorenulls=True).alias(f"s{k}") for k in (0, 1)]).dropna(subset=["s0", "s1"])
    largest = labels.groupBy(*by, "component").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("lead"))
    leads = largest.join(pair.withColumnsRenamed({"component": "lead", "s0": "r0", "s1": "r1"}), [*by, "lead"])
    met = pair.join(leads, by) if by else pair.crossJoin(F.broadcast(leads))
    turned = _dot(F.col("s0"), F.col("r1")) + _dot(F.col("s1"), F.col("r0")) > _dot(F.col("s0"), F.col("r0")) + _dot(F.col("s1"), F.col("r1"))
    told = met.where((F.col("component") != F.col("lead")) & turned).select(*by, "component", F.lit(True).alias("_turn"))
    out = labels.join(told, [*by, "component"], "left")
    return out.withColumn("label", F.when(F.col("_turn"), 1 - F.col("label")).otherwise(F.col("label"))).select(*labels.columns)


def _products(by: list[str], kind: pa.Schema):
    """Sums of d times d of the rows of each group in a batch."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
            d = np.array(b.column("d").to_pylist(), float).reshape(b.num_rows, -1)
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            rows = [dict(zip(by, k, strict=True)) | {"n": len(i), "m": (d[i].T @ d[i]).ravel()} for k, i in at.items()]
            if rows:
                yield pa.RecordBatch.from_pylist([r | {"m": r["m"].tolist()} for r in rows], kind)

    return summed


def leading_direction(pairs: DataFrame, a: str, b: str, by: list[str], least: int = 8) -> DataFrame:
    """(by, n, direction): the unit vector along which the differences a - b of a group's pairs of vectors point most, of either sign.

    Its largest part is positive, the first of equally large ones. Groups of fewer than `least` pairs are left out, pairs with
    a null as well. Products of differences are summed where the rows are: a task holds one small matrix a group and batch.
    """
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")).alias("d"))
    fields = [d.schema[c] for c in by]
    part = StructType([*fields, StructField("n", d.select(F.lit(1).cast("long").alias("n")).schema["n"].dataType), StructField("m", ArrayType(DoubleType()))])
    partial = d.mapInArrow(_products(by, to_arrow_schema(part)), part)
    cells = partial.select(*by, "n", F.posexplode("m").alias("i", "v")).groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    whole = cells.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m")).where(F.col("n") >= least)
    out = StructType([*fields, part["n"], StructField("direction", ArrayType(DoubleType()))])
    kind = to_arrow_schema(out)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                m = np.array(r.pop("m"))
                k = round(len(m) ** 0.5)
                w = np.linalg.eigh(m.reshape(k, k))[1][:, -1]
                top = int(np.argmax(np.round(np.abs(w), 9)))
                r["direction"] = (w * (1 if w[top] > 0 else -1)).tolist()
            yield pa.RecordBatch.from_pylist(rows, kind)

    return whole.mapInArrow(solve, out)


def medians(rows: DataFrame, by: list[str], value: str, width: float = 0.005) -> DataFrame:
    """(by, median): exact, the mean of the two in the middle, with only the rows near the middle sorted.

    Quantiles that are right within a twentieth of width give two bounds around the middle; the rows below are counted.
    """
    from pyspark.sql import Window

    near = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    bounds = near.groupBy(*by).agg(F.percentile_approx(value, [0.5 - width, 0.5 + width], F.lit(int(20 / width))).alias("_q"), F.count("*").alias("_n"))
    met = near.join(bounds, by) if by else near.crossJoin(F.broadcast(bounds))
    below = met.groupBy(*by).agg(F.count_if(F.col(value) < F.col("_q")[0]).alias("_below"))
    inside = met.where((F.col(value) >= F.col("_q")[0]) & (F.col(value) <= F.col("_q")[1]))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    told = ranked.join(below, by) if by else ranked.crossJoin(F.broadcast(below))
    at = F.col("_r") + F.col("_below")
    middle = (at == F.floor((F.col("_n") + 1) / 2)) | (at == F.floor(F.col("_n") / 2) + 1)
    return told.where(middle).groupBy(*by).agg(F.avg(value).alias("median"))


def two_sides(rows: DataFrame, vector: str, by: list[str], directions: DataFrame) -> DataFrame:
    """rows with projection and label: 1 over the median of the group's projections on its direction, else 0."""
    met = rows.join(directions.select(*by, "direction"), by) if by else rows.crossJoin(F.broadcast(directions.select("direction")))
    placed = met.withColumn("projection", _dot(F.col(vector), F.col("direction"))).drop("direction")
    cuts = medians(placed, by, "projection")
    told = placed.join(cuts, by) if by else placed.crossJoin(F.broadcast(cuts))
    return told.withColumn("label", F.when(F.col("projection") > F.col("median"), 1).otherwise(0)).drop("median")


def sides_report(placed: DataFrame, by: list[str], frame: str) -> DataFrame:
    """(by, n, separation, within, contrast, disagreement, usable) of two_sides() rows: how well two sides are told apart.

    Rows of one frame must be on unlike sides; disagreement is the share of frames of two rows that are, usable 0.8 and more.
    """
    side = lambda k, f: F.coalesce(f(F.when(F.col("label") == k, F.col("projection"))), F.lit(0.0))
    gap = F.abs(side(1, F.avg) - side(0, F.avg))
    within = (side(1, F.stddev_pop) + side(0, F.stddev_pop)) / 2
    own = placed.groupBy(*by).agg(F.count("*").alias("n"), gap.alias("separation"), within.alias("within"))
    frames = placed.where(F.col(frame).isNotNull()).groupBy(*by, frame).agg(F.count("*").alias("k"), (F.min("label") != F.max("label")).alias("split")).where("k = 2")
    split = frames.groupBy(*by).agg(F.avg(F.col("split").cast("double")).alias("disagreement"))
    met = own.join(split, by, "left") if by else own.crossJoin(F.broadcast(split))
    contrast = F.when(F.col("within") > 1e-6, F.col("separation") / F.col("within")).otherwise(0.0)
    return met.select(*by, "n", "separation", "within", contrast.alias("contrast"), "disagreement", F.coalesce(F.col("disagreement") >= 0.8, F.lit(False)).alias("usable"))
