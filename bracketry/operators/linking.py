"""Names in running text: which spans of a text link to which target.

Aliases are taken longest first. Each looks at its first place in the text alone, between word boundaries and in any case; it
links there unless the target has a link already or a longer alias took part of the place. Places count code points from 0.

Aliases of a counted size go to all tasks as one Aho-Corasick automaton, which finds the first places of all of them in one
pass over a text. Beyond that size a text meets, by a join on words, only the aliases whose rarest word it has.
"""

from __future__ import annotations

import bisect
import unicodedata
import uuid
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of aliases up to which an automaton is sent to all tasks.
AUTOMATON_LETTERS = 2_000_000
#: What boundaries are beside: letters, digits and underscore, of ASCII alone as in most pattern languages, or of all scripts.
ASCII, ALL_SCRIPTS = "A-Za-z0-9_", r"\p{L}\p{N}_"
#: Letters that a last name and a title have at least, to be aliases.
MIN_SURNAME, MIN_TITLE = 4, 5
SPANS = "array<struct<start: int, end: int, kind: int, target_id: string, alias: string>>"

_automata: dict[str, ahocorasick.Automaton] = {}


def person_names(name: Column) -> Column:
    """The whole name, and the last word of two and more if it has MIN_SURNAME letters."""
    words = F.split(F.trim(name), r"\s+")
    last = F.element_at(words, -1)
    return F.when((F.size(words) > 1) & (F.char_length(last) >= MIN_SURNAME), F.array(F.trim(name), last)).otherwise(F.array(F.trim(name)))


def title_names(*titles: Column) -> Column:
    """Titles of MIN_TITLE letters and more, in their order."""
    return F.filter(F.array(*[F.trim(t) for t in titles]), lambda t: F.char_length(t) >= MIN_TITLE)


def alias_table(targets: DataFrame, word: str = ASCII) -> DataFrame:
    """(kind, target_id, alias, place) from targets (kind int, target_id, names array): of equal aliases of a kind the first target's.

    Order is by kind, target_id as text, and place among the names. Null names, and those without a word character, which no
    boundary could hold, are left out.
    """
    rows = targets.select("kind", F.col("target_id").cast("string").alias("target_id"), F.posexplode("names").alias("place", "alias"))
    first = F.min(F.struct("target_id", "place", "alias")).alias("x")
    return rows.where(F.col("alias").rlike(f"[{word}]")).groupBy("kind", F.lower("alias").alias("_")).agg(first).select("kind", "x.*")


def folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    if text.isascii():
        return text.lower()
    return "".join(c if len(low := c.lower()) != 1 else low for c in text)


def _clear(text: str, start: int, end: int, is_word) -> bool:
    """Whether both ends lie between a word character and another one."""
    before, after = start > 0 and is_word(text[start - 1]), end < len(text) and is_word(text[end])
    return before != is_word(text[start]) and after != is_word(text[end - 1])


def _chosen(first: Iterable[tuple[int, tuple]]) -> list[tuple]:
    """Spans out of (start, alias row) in the order of aliases; row: (alias, kind, target_id)."""
    starts: list[int] = []
    spans: list[tuple] = []
    done = set()
    for start, (alias, kind, target) in first:
        end = start + len(alias)
        if (kind, target) in done:
            continue
        at = bisect.bisect_left(starts, start)
        if (at < len(spans) and spans[at][0] < end) or (at and spans[at - 1][1] > start):
            continue
        starts.insert(at, start)
        spans.insert(at, (start, end, kind, target, alias))
        done.add((kind, target))
    return spans


def _rank(row: tuple) -> tuple:
    alias, kind, target, place = row
    return -len(alias), kind, target, place


def _automaton(rows: list[tuple]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, (alias, *_) in enumerate(rows):
        by.setdefault(folded(alias), []).append(i)
    for text, at in by.items():
        out.add_word(text, (len(text), at))
    out.make_automaton()
    return out


def _by_automaton(text: str, rows: list[tuple], automaton: ahocorasick.Automaton, is_word) -> list[tuple]:
    low, first = folded(text), {}
    for end, (n, at) in automaton.iter(low):
        start = end + 1 - n
        if at[0] not in first and _clear(low, start, end + 1, is_word):
            first.update(dict.fromkeys(at, start))
    return _chosen((first[i], rows[i][:3]) for i in sorted(first))


def _by_search(text: str, rows: list[tuple], is_word) -> list[tuple]:
    low, found = folded(text), []
    for row in sorted(rows, key=_rank):
        alias = folded(row[0])
        start = low.find(alias)
        while start >= 0 and not _clear(low, start, start + len(alias), is_word):
            start = low.find(alias, start + 1)
        if start >= 0:
            found.append((start, row[:3]))
    return _chosen(found)


def _word_test(word: str):
    if word not in (ASCII, ALL_SCRIPTS):
        raise ValueError("word is ASCII or ALL_SCRIPTS")
    return lambda c: c == "_" or (c.isascii() or word == ALL_SCRIPTS) and unicodedata.category(c)[0] in "LN"


def _spans(found: list[list[tuple] | None]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("target_id", pa.string()), ("alias", pa.string())]))
    names = ("start", "end", "kind", "target_id", "alias")
    return pa.array([[dict(zip(names, s, strict=True)) for s in x or ()] for x in found], kind)


def link_spans(docs: DataFrame, aliases: DataFrame, text_col: str = "text", word: str = ASCII, automaton_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """docs with spans: array<struct<start, end, kind, target_id, alias>> by place. aliases: as alias_table() gives them.

    Whole texts are read; a null text has no spans, nor has any without aliases. Every row has its own, repeated or not. A
    column spans of docs is replaced. Each task holds the automaton, or the aliases that a text may have.
    """
    spark = docs.sparkSession
    rows = aliases.select("alias", "kind", F.col("target_id").cast("string"), "place")
    letters = rows.agg(F.sum(F.char_length("alias"))).first()[0] or 0
    if letters <= automaton_letters:
        held = spark.sparkContext.broadcast(sorted(map(tuple, rows.collect()), key=_rank))
        uid = uuid.uuid4().hex

        @F.arrow_udf(SPANS)
        def linked(texts: pa.Array) -> pa.Array:
            if uid not in _automata:
                _automata.clear()
                _automata[uid] = _automaton(held.value)
            is_word = _word_test(word)
            return _spans([_by_automaton(t, held.value, _automata[uid], is_word) if t and held.value else None for t in texts.to_pylist()])

        # else Spark asks for spans before it lists them, and reads each text twice
        return docs.withColumn("spans", linked.asNondeterministic()(F.col(text_col).cast("string")))

    @F.arrow_udf(SPANS)
    def searched(texts: pa.Array, candidates: pa.Array) -> pa.Array:
        is_word = _word_test(word)
        pairs = zip(texts.to_pylist(), candidates.to_pylist(), strict=True)
        return _spans([_by_search(t, [(c["alias"], c["kind"], c["target_id"], c["place"]) for c in cs], is_word) if t and cs else None for t, cs in pairs])

    given = docs.drop("spans")
    found = candidates(given.select(F.col(text_col).cast("string").alias("text")), rows, word)
    joined = given.withColumn("_digest", F.sha2(F.col(text_col).cast("string").cast("binary"), 256)).join(found, "_digest", "left")
    return joined.withColumn("spans", searched.asNondeterministic()(F.col(text_col).cast("string"), F.col("_rows"))).drop("_digest", "_rows")


def candidates(texts: DataFrame, aliases: DataFrame, word: str = ASCII) -> DataFrame:
    """(_digest, _rows): for each distinct text the aliases whose rarest word it has.

    Both ends of an alias are boundaries, so that its words are words of a text that has it. The rarest word is that in fewest
    texts; a frequent one has many texts only if no word of its alias is rare.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.translate(F.lower(c), "ς", "σ"), F.lit(f"[{word}]+"), F.lit(0)))
    said = texts.where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("_digest"), F.explode(words(F.col("text"))).alias("w")).distinct()
    own = aliases.select(F.struct(*aliases.columns).alias("row"), F.explode(words(F.col("alias"))).alias("w"))
    counts = said.join(own.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    # a word that no text has is the rarest of all: such an alias has no candidates
    keyed = own.join(counts, "w", "left").groupBy("row").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("k"))
    met = said.join(keyed.where("k.n > 0").select("row", F.col("k.w").alias("w")), "w")
    return met.groupBy("_digest").agg(F.collect_list("row").alias("_rows"))


def segments(text: Column, spans: Column) -> Column:
    """array<struct<text, kind, target_id>>: the text in pieces, those of spans with their target."""
    edge = F.struct(F.char_length(text).alias("start"), F.char_length(text).alias("end"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("alias"))
    stops = F.concat(spans, F.array(edge))
    none = F.lit(None)

    def piece(s: Column, i: Column) -> Column:
        behind = F.when(i > 0, F.get(stops, i - 1)["end"]).otherwise(0)
        between = F.struct(F.substring(text, behind + 1, s["start"] - behind).alias("text"), none.cast("int").alias("kind"), none.cast("string").alias("target_id"))
        own = F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["kind"].alias("kind"), s["target_id"].alias("target_id"))
        return F.array(between, own)

    return F.filter(F.flatten(F.transform(stops, piece)), lambda p: p["text"] != "")


def mention_counts(linked: DataFrame) -> DataFrame:
    """(kind, target_id, n_texts, n_aliases) over the spans of all texts."""
    each = linked.select(F.inline("spans"))
    return each.groupBy("kind", "target_id").agg(F.count("*").alias("n_texts"), F.count_distinct(F.lower("alias")).alias("n_aliases"))

