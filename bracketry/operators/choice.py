"""Greedy choice: items that between them cover the most, each picked for what it adds to those before it.

What an item adds never grows, so that its present gain bounds all later ones. An item that comes before all others it still
shares an element with (by gain, then by id) will be picked before any of them, with the gain it has now: all such items are
settled in one round, and the picks are those of one at a time. Gains of settled items are also bounds for the rest: once `most`
items are settled, whatever can't reach the last of them is dropped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import stored

#: Rows that go on in one task, once so few are left.
FEW = 20_000


def _one_by_one(most: int):
    """Picks among few rows: a heap of the gains known last, which bound the present ones. The top is counted anew, and picked if it stays."""

    def picks(rows: pd.DataFrame) -> pd.DataFrame:
        of = defaultdict(dict)
        for i, e, w in zip(rows["i"], rows["e"], rows["w"], strict=True):
            of[i][e] = int(w)
        heap = [(-sum(own.values()), i) for i, own in of.items()]
        heapq.heapify(heap)
        covered, out = set(), []
        while heap and len(out) < most:
            bound, i = heapq.heappop(heap)
            gain = sum(w for e, w in of[i].items() if e not in covered)
            if gain == -bound:
                out.append((i, gain))
                covered.update(of[i])
            elif gain:
                heapq.heappush(heap, (-gain, i))
        return pd.DataFrame(out, columns=["i", "gain"])

    return picks


def greedy_cover(rows: DataFrame, item: str, element: str, most: int, weight: str | None = None, few: int = FEW) -> DataFrame:
    """(item, gain, rank): the first `most` picks, each the item that adds most weight of elements not yet covered, ties by item.

    weight is of whole numbers, one an element; of several the largest counts. Null items, elements and weights and weights of 0
    and less are left out, repeated rows count once, and items that add nothing are not picked: there may be fewer than `most`.
    A round is a stored table of what is left. Rounds are as many as the longest chain of items that wait for one another; the
    last `few` rows at most go on in one task, with the same picks.
    """
    if most < 1:
        raise ValueError("most is 1 or more")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    kept = rows.select(F.col(item).alias("i"), F.col(element).alias("e"), w.alias("w")).where("i is not null and e is not null and w > 0")
    if weight:
        largest = kept.groupBy("e").agg(F.max("w").alias("w"))
        left = stored(kept.select("i", "e").distinct().join(largest, "e").select("i", "e", "w"))
    else:
        left = stored(kept.distinct())
    top = lambda d: d.orderBy(F.desc("gain"), "i").limit(most)
    picked = None
    while (n_left := left.count()) > few:
        gains = left.groupBy("i").agg(F.sum("w").alias("gain"))
        keyed = left.join(gains, "i").select("e", F.struct((-F.col("gain")).alias("g"), F.col("i")).alias("p"))
        first = keyed.groupBy("e").agg(F.min("p").alias("first"))
        waiting = keyed.join(first, "e").groupBy("p").agg(F.bool_or(F.col("p.i") != F.col("first.i")).alias("waits"))
        state = stored(waiting.select("p.i", (-F.col("p.g")).alias("gain"), "waits"))
        now = state.where("not waits").select("i", "gain")
        picked = stored(top(now if picked is None else picked.unionAll(now)))
        # at most `most` rows, of which the last is the bar
        n, bar = picked.agg(F.count("*"), F.min("gain")).first()
        could = state.where(F.col("waits") & (F.col("gain") >= (bar if n == most else 1))).select("i")
        covered = left.join(now.select("i"), "i", "left_semi").select("e").distinct()
        left = stored(left.join(could, "i", "left_semi").join(covered, "e", "left_anti"))
    if n_left or picked is None:
        schema = StructType([StructField("i", left.schema["i"].dataType), StructField("gain", LongType())])
        rest = left.groupBy().applyInPandas(_one_by_one(most), schema)
        picked = stored(rest if picked is None else picked.unionAll(rest))
    order = Window.orderBy(F.desc("gain"), "i")
    return top(picked).select(F.col("i").alias(item), "gain", F.row_number().over(order).alias("rank"))
