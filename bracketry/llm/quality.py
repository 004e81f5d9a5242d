"""Quality rules: figures of each text, and lines that too many documents of one host share.

DataFrame functions alone. Lines are normalised (lower case, digits as 0, white space as one space) and hashed. A host's
distinct documents that have a line are counted, by their ids. Lines above the limits are removed, and a document that they
deplete is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_by_size, materialize, split_words

#: Documents of a host that may share a line: so many, or that share of the host's documents if it is more; and the share of a
#: document's words that frequent lines may take.
MAX_SHARING, MAX_SHARE, MAX_REMOVED = 20, 0.01, 0.5
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text, the first occurrence included."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_: Column) -> Column:
        twin = lambda x, k: ((k > 0) & (x["h"] == F.get(sorted_, k - 1)["h"])) | (x["h"] == F.get(sorted_, k + 1)["h"])
        at = F.array_sort(F.transform(F.filter(sorted_, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["end"])).cast("long").alias("n"), i.alias("end"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    many = F.size(words) >= WINDOW + 1
    return F.when(many & (F.size(F.array_distinct(hashes)) < F.size(words) - (WINDOW - 1)), F.element_at(F.transform(F.array(placed), covered), 1)).otherwise(F.lit(0).cast("long"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"[{SPACE}]+", " "))


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, which replace such columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = docs.withColumn("_words", split_words(F.col(text_col))).withColumn("_full", full)
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_words", "_full")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, text_hash, gone, n_removed) for each document with frequent lines: their hashes and how many words they take in it.

    A document counts once for a line and a host, whatever its rows; rows without an id count by their texts. A null host is
    the host "".
    """
    key = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(host_col), F.lit("")).alias("host")]
    lines = F.filter(F.transform(lines_of(F.col(text_col)), normal_line), lambda x: x != "")
    placed = docs.select(*key, F.posexplode(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("w")))).alias("at", "l"))
    # a line's places in the text: repeated rows have the same
    times = F.size(F.collect_set("at"))
    own = materialize(placed.groupBy("id", "text_hash", "host", F.col("l.line").alias("line")).agg((F.max("l.w") * times).alias("w")), "lines")
    document = F.struct("id", F.when(F.col("id").isNull(), F.col("text_hash")).alias("text_hash")).alias("document")
    once = own.select("host", "line", document).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > MAX_SHARING)
    sizes = docs.select(key[2], F.struct(key[0], F.when(key[0].isNull(), key[1]).alias("text_hash")).alias("document")).distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    often = join_by_size(once, materialize(sizes, "hosts"), ["host"], "n_docs").where(F.col("n") > MAX_SHARE * F.col("n_docs")).select("host", "line", "n")
    marked = join_by_size(own, materialize(often, "often"), ["host", "line"], "n")
    return marked.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("gone"), F.sum("w").cast("long").alias("n_removed"))


def _verdict(n_words: Column, n_removed: Column) -> Column:
    return n_removed <= MAX_REMOVED * n_words


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col with the figures of figures(), n_removed and kept.

    A document is kept unless base_failed, or frequent lines take more than MAX_REMOVED of its words. A null text has no
    words and fails; a null host is the host "". Rows with equal ids and texts have equal results, each its own row; an
    empty table gives no rows.
    """
    d = figures(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text")), "_text").drop("_text")
    gone = frequent_lines(docs, id_col, text_col, host_col).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "n_removed")
    both = d.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    removed = F.coalesce("n_removed", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & _verdict(F.col("n_words"), removed)
    return both.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", removed.alias("n_removed"), kept.alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs that rules() keeps, with their texts less frequent lines. Other columns stay as they are; other lines too, byte for byte."""
    gone = frequent_lines(docs, id_col, text_col, host_col).toDF("_id", "_hash", "_gone", "_n_removed")
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    joined = docs.join(gone, same, "left").withColumn("_row", F.struct(*[docs[c] for c in docs.columns]))
    marked = figures(joined.select("_row", "_gone", "_n_removed", F.col(f"_row.{text_col}").alias("_text")), "_text")
    kept = marked.where(~F.col("base_failed") & _verdict(F.col("n_words"), F.coalesce("_n_removed", F.lit(0))))
    rest = F.filter(lines_of(F.col("_text")), lambda x: ~F.coalesce(F.array_contains("_gone", F.xxhash64(normal_line(x))), F.lit(False)))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(rest, "\n"))
    return kept.select(*[(text if c == text_col else F.col(f"_row.{c}")).alias(c) for c in docs.columns])
