"""Removal of repeated line runs with a suffix array over line ids.

DataFrame functions alone. Line ids are ranked, and ranks of runs of 1, 2, 4, ... lines follow by prefix doubling: the rank of
a pair of ranks in sorted order, so that ranks order the suffixes that start at each line by their first 2^k lines. Runs that
occur once drop out at once. Two ranks that overlap name a prefix of any length, and the suffixes that share the name are the
interval of the suffix array whose longest common prefix is at least so long. Each interval is known by its member that stands
first in the text. A later suffix and that first one go on in step for as long as their longest common prefix lasts: the lines
from which they do so, one after the other, are one maximal repeated run. The first copy stays, later copies are deleted.

A run counts from MIN_WORDS words on. All lines of such runs are found from the shortest such prefixes that start at each line
and that end at each line: a line of a longer repeated run lies in one of them that is repeated as well. Every line with
a word has one word at least, so that no such prefix has more than MIN_WORDS lines and the doubling ends after its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, join_by_size, left_join_by_size, materialize

MIN_WORDS = 50


def _shortest(words: Column, least: int) -> Column:
    """How many of the first values add up to least; null if all don't."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, w: F.when(a["s"] < least, F.struct((a["s"] + w).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(words, start, step, lambda a: F.when(a["s"] >= least, a["n"]))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row for each line with a word: d, t, seq, line_no, two hashes, and the lengths of the shortest runs from and to it."""
    clean = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), F.trim(F.regexp_replace(x, f"[{SPACE}]+", " ")).alias("x")))
    full = F.transform(F.filter(clean, lambda e: e["x"] != ""), lambda e: F.struct(e["no"].alias("no"), F.xxhash64(e["x"]).alias("a"), F.xxhash64(F.lit("line"), e["x"]).alias("b"), F.size(F.split(e["x"], " ")).alias("w")))
    own = docs.select(F.col(id_col).alias("d"), text_key(F.col(text_col)).alias("t"), full.alias("e")).withColumn("ws", F.col("e.w")).withColumn("back", F.reverse("ws"))
    n = F.size("ws")
    # the end of the first line and the start of the last one are the ends of the document
    placed = F.transform("e", lambda e, i: F.struct(i.alias("seq"), e["no"].alias("line_no"), e["a"].alias("a"), e["b"].alias("b"), _shortest(F.slice("ws", i + 1, least), least).alias("ahead"), _shortest(F.slice("back", n - i, least), least).alias("behind")))
    return own.select("d", "t", F.inline(placed))


def _ranked(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups (keys, n) with a rank that follows the order of keys: rows are range partitioned and sorted, and row ids grow along them."""
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select(*keys, "n", F.monotonically_increasing_id().alias(name)), "ranks")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.d").eqNullSafe(F.col(f"{b}.d")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))


def suffixes(lines: DataFrame) -> tuple[DataFrame, int]:
    """Lines that occur twice or more, with ranks r0 to rk of the runs of 1 to 2^k lines from each, null where such a run occurs once; and k."""
    twice = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    ranked = join_by_size(lines, _ranked(twice, ["a", "b"], "r0"), ["a", "b"], "n").drop("a", "b", "n")
    now = materialize(ranked.dropDuplicates(["d", "t", "seq"]), "suffixes")
    longest = now.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 1
    order, k = Window.partitionBy("d", "t").orderBy("seq"), 0
    while 2 << k <= longest:
        step, rank = 1 << k, f"r{k}"
        far = F.lead(F.struct("seq", rank), step).over(order)
        pair = now.withColumn("far", far).withColumn("y", F.when((F.col("far.seq") == F.col("seq") + step) & F.col(rank).isNotNull(), F.col(f"far.{rank}"))).drop("far")
        pair = materialize(pair.withColumn("x", F.when(F.col("y").isNotNull(), F.col(rank))), "pairs")
        groups = pair.where("y is not null").groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
        ranks = _ranked(groups, ["x", "y"], f"r{k + 1}")
        if ranks.isEmpty():
            break
        # lines without a pair stay where they are: no task gets all of them
        now = left_join_by_size(pair, ranks, ["x", "y"], "n").drop("x", "y")
        k += 1
    return materialize(now, "suffixes"), k


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Maximal repeated runs: (d, t, lines, first_d, first_t, first_line), one row for each later copy.

    lines are the numbers of the run's lines from 0, first_d and first_line where the copy that stands first begins. A later
    copy may have parts from different first copies, which overlap or not; each is a row. t and first_t are hashes of the texts.
    """
    now, k = suffixes(materialize(line_table(docs, id_col, text_col, least), "lines"))
    ranks = F.array(*[F.col(f"r{i}") for i in range(k + 1)])
    at = now.select("d", "t", "seq", ranks.alias("r"))
    runs = now.select("d", "t", F.explode(F.array(F.struct(F.col("seq").alias("start"), F.col("ahead").alias("m")), F.struct((F.col("seq") - F.col("behind") + 1).alias("start"), F.col("behind").alias("m")))).alias("run")).select("d", "t", "run.*").where("m is not null").distinct()
    level = F.floor(F.log2("m") + 1e-9).cast("int")
    runs = runs.withColumn("level", level).where(F.col("level") <= k).withColumn("last", (F.col("start") + F.col("m") - F.expr("shiftleft(1, level)")).cast("int"))
    both = runs.alias("n").join(at.alias("p"), _same("n", "p") & (F.col("n.start") == F.col("p.seq"))).join(at.alias("q"), _same("n", "q") & (F.col("n.last") == F.col("q.seq")))
    named = both.select("n.d", "n.t", "n.start", "n.m", F.get("p.r", F.col("level")).alias("x"), F.get("q.r", F.col("level")).alias("y")).where("x is not null and y is not null")
    named = materialize(named.withColumn("at", F.struct("d", "t", "start")), "runs")
    intervals = materialize(named.groupBy("m", "x", "y").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "intervals")
    later = join_by_size(named, intervals, ["m", "x", "y"], "n").where(F.col("at") > F.col("first"))
    # suffixes at one distance from the same first copy share one prefix for as long as each begins within those before it
    later = later.select("d", "t", "start", (F.col("start") + F.col("m")).alias("end"), F.col("first.d").alias("first_d"), F.col("first.t").alias("first_t"), (F.col("start") - F.col("first.start")).alias("apart"))
    along = Window.partitionBy("d", "t", "first_d", "first_t", "apart").orderBy("start", "end")
    upto = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = later.withColumn("opens", (upto.isNull() | (F.col("start") > upto)).cast("int")).withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = parted.groupBy("d", "t", "first_d", "first_t", "apart", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = materialize(found.withColumn("first_start", (F.col("start") - F.col("apart")).cast("int")), "found")
    places = now.select("d", "t", "seq", "line_no")
    each = found.select("d", "t", "first_d", "first_t", "first_start", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("seq"))
    own = each.alias("g").join(places.alias("p"), _same("g", "p") & (F.col("g.seq") == F.col("p.seq"))).select("g.*", "line_no")
    lines = own.groupBy("d", "t", "first_d", "first_t", "first_start", "start").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))
    begins = places.select(F.col("d").alias("pd"), F.col("t").alias("pt"), F.col("seq").alias("ps"), F.col("line_no").alias("first_line"))
    return lines.join(begins, F.col("first_d").eqNullSafe(F.col("pd")) & (F.col("first_t") == F.col("pt")) & (F.col("first_start") == F.col("ps"))).select("d", "t", "lines", "first_d", "first_t", "first_line")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(d, t, removed): for each document with lines to delete, their numbers from 0, ascending: those of its later copies."""
    runs = repeated_runs(docs, id_col, text_col, least)
    return runs.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with the text less later copies of line runs, and n_lines and removed (line numbers), which replace such columns.

    Texts stand in the order of their ids, then of a hash. Lines are compared with runs of white space as one space; lines
    without a word are never compared nor deleted, and do not break a run. A null text stays null and has no lines, an
    empty one has one. Rows with equal ids and texts count as one and keep the same lines. Null ids come first. An empty
    table gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, least).toDF("_line_doc", "_line_key", "_line_gone")
    names = [c for c in docs.columns if c not in ("n_lines", "removed")]
    left = docs.select(*names)
    same = F.col(id_col).eqNullSafe(F.col("_line_doc")) & (text_key(F.col(text_col)) == F.col("_line_key"))
    lines, removed = F.split(F.col(text_col), "\n"), F.col("_line_gone")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    text = F.when(removed.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in names]
    n = F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0)
    return left.join(gone, same, "left").select(*out, n.alias("n_lines"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))
