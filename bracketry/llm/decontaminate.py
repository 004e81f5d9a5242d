"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

DataFrame functions alone. An item and a window of a document are compared by their shingles of five words. Every window that
has as many shingles as an item, and one of the benchmark's among them, has a fingerprint: a window without one has no
similarity at all. Equal windows are one. Fingerprints are looked up in an index of blocks: block thresholds add up to the
radius less the blocks but one, so that two fingerprints within the radius are within the threshold of one block at least,
and every item is listed under all values that near to its own. What the index finds is verified by the exact similarity of
the shingles weighted by their counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: The radius leaves about one pair in seventy of similarity 0.8 outside; above 0.85 it leaves fewer than one in a thousand.
RADIUS, BLOCKS, BLOCK_BITS = 16, 4, 16
#: Bits in which a block may differ. They add up to RADIUS - BLOCKS + 1: more in every block make more than RADIUS in all.
THRESHOLDS = (4, 3, 3, 3)
#: Shingles of a benchmark, or documents with one of them, that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles, in order: lower case, words of letters and digits; none where words are fewer."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = lambda ws: F.when(F.size(ws) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(ws) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))
    # one element: the words are split once for all that follows
    return F.get(F.transform(F.array(words), hashed), 0)


def fingerprint(hashes: str) -> Column:
    """SimHash of a column of hashes: each bit that more than half of them have, copies counted."""
    count = f"aggregate({hashes}, 0, (c, h) -> c + cast(shiftrightunsigned(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(2 * {count} > size({hashes}), shiftleft(1L, b), 0L))")


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller counts of each shingle over the sum of the larger ones."""
    times = "size(filter({0}, y -> y = x))"
    both = f"if(size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), aggregate(array_distinct({a}), 0, (n, x) -> n + least({times.format(a)}, {times.format(b)})))"
    return F.expr(f"aggregate(array({both}), 0D, (s, n) -> n / (size({a}) + size({b}) - n))")


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    items = benchmark.select(F.col(id_col).alias("item"), shingles(F.col(text_col)).alias("own")).where(F.size("own") > 0)
    return materialize(items.withColumn("own_print", fingerprint("own")), "items")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, which are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(d, t, windows): the windows of each document, as many shingles as some item has, in which one of that item's is."""
    wanted = items.select(F.size("own").alias("n"), F.explode(F.array_distinct("own")).alias("h")).distinct()
    wanted = _small(wanted)
    placed = docs.select("d", "t", F.size("all").alias("total"), F.posexplode("all").alias("pos", "h"))
    found = placed.join(wanted, "h").groupBy("d", "t", F.least("n", "total").alias("m"), "total").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    # the windows that begin after the hit before and reach this one
    first = lambda x, j: F.greatest(F.lit(0), x - F.col("m") + 1, F.coalesce(F.get("p", j - 1), F.lit(-1)) + 1)
    spans = F.transform("p", lambda x, j: F.struct(first(x, j).alias("a"), F.least(x, F.col("total") - F.col("m")).alias("b")))
    starts = F.flatten(F.transform(F.filter(spans, lambda s: s["a"] <= s["b"]), lambda s: F.sequence(s["a"], s["b"])))
    return materialize(found.select("d", "t", "m", starts.alias("starts")).where(F.size("starts") > 0), "windows")


def within(bits: int, share: int) -> list[int]:
    """Every pattern of at most share set bits."""
    return [sum(1 << b for b in c) for k in range(share + 1) for c in combinations(range(bits), k)]


def _block(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def lookup(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(print, item) for every fingerprint and item within RADIUS. prints has one row for each fingerprint."""
    around = F.array(*[F.array(*[F.lit(x) for x in within(BLOCK_BITS, t)]) for t in THRESHOLDS])
    of = lambda c: F.posexplode(F.array(*[_block(F.col(c), k) for k in range(BLOCKS)])).alias("block", "value")
    index = items.select("item", "own_print", of("own_print")).select("item", "own_print", "block", F.explode(F.transform(F.get(around, F.col("block")), lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    # the planner takes the listed values for as small as the items
    found = prints.select("print", of("print")).join(index.hint("merge"), ["block", "value"])
    return found.where(F.bit_count(F.col("print").bitwiseXOR(F.col("own_print"))) <= RADIUS).select("print", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, t, item_col, similarity, start_word, n_words): the best window of each document and item that are alike.

    A window has as many words as the item, or is the whole document where that has fewer. Items of fewer than five words
    are not looked for, null and empty texts hold none. Of windows with equal similarity the first counts. Rows with equal
    ids and texts give one row. Either table may be empty. t is xxhash64 of the text.
    """
    items = items_of(benchmark, item_col, item_text_col)
    texts = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("x"))
    near = windows_of(texts.select("d", "t", shingles(F.col("x")).alias("all")), items)
    # whole texts are not shuffled where few documents have windows
    keys = _small(near.select(F.col("d").alias("kd"), F.col("t").alias("kt")).distinct())
    held = texts.join(keys, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")), "left_semi").select("d", "t", shingles(F.col("x")).alias("all"))
    of = near.groupBy(F.col("d").alias("kd"), F.col("t").alias("kt")).agg(F.collect_list(F.struct("m", "starts")).alias("windows"))
    chosen = held.join(of, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt"))).select("d", "t", F.explode("windows").alias("w"), "all")
    cut = chosen.select("d", "t", F.explode(F.transform("w.starts", lambda s: F.struct(s.alias("s"), F.slice("all", s + 1, F.col("w.m")).alias("own")))).alias("w"))
    cut = cut.select("d", "t", "w.s", "w.own", F.xxhash64("w.own").alias("k1"), F.xxhash64(F.lit("window"), "w.own").alias("k2"))
    cut = materialize(cut.dropDuplicates(["d", "t", "s", "k1", "k2"]), "cut")
    unlike = cut.groupBy("k1", "k2").agg(F.any_value("own").alias("w_own"))
    unlike = materialize(unlike.withColumn("print", fingerprint("w_own")), "unlike")
    pairs = lookup(unlike.select("print").distinct(), items)
    alike = unlike.join(pairs, "print").join(items.select("item", "own"), "item").withColumn("similarity", weighted_similarity("w_own", "own")).where(F.col("similarity") >= SIMILARITY)
    alike = alike.select("k1", "k2", "item", "similarity", (F.size("w_own") + SHINGLE - 1).alias("n"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("s").alias("at"), "n")).alias("b")
    out = cut.select("d", "t", "s", "k1", "k2").join(alike, ["k1", "k2"]).groupBy("d", "t", "item").agg(best)
    return out.select(F.col("d").alias(id_col), "t", F.col("item").alias(item_col), (-F.col("b.s")).alias("similarity"), F.col("b.at").cast("long").alias("start_word"), F.col("b.n").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an item. Columns stay as they are; a row with a null id or text is kept or dropped alike."""
    gone = contaminated(docs.select(id_col, text_col), benchmark, id_col, text_col).select(F.col(id_col).alias("_d"), F.col("t").alias("_t")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_d")) & (F.xxhash64(docs[text_col]) == F.col("_t")), "left_anti")
