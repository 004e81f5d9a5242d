"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits and signs that stand for letters), matched against the lexicon by one
Aho-Corasick automaton and scored by the weight of whole-word matches for their length. Occurrences inside an exception
phrase don't count. The lexicon, its weights and further exception phrases are learned from labelled rows.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, frugal, materialize, release

#: Signs and digits read as letters, and letters of other scripts that look like Latin ones.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "б": "b", "в": "b", "г": "r", "д": "d", "е": "e", "ё": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ς": "c",
    # Latin
    "ɡ": "g", "ı": "i", "ℓ": "l",
}
#: Phrases in which a word of abuse is none.
PHRASES = ("trash can", "trash bin", "clown fish", "idiot proof", "pond scum", "soap scum", "stupid question")
#: Labelled rows from which the lexicon is learned, at most; a sample by hash of the id where there are more.
MAX_LABELLED = 20_000
#: A term needs so many toxic documents, a rate so many times that of others, and so many standard errors above them.
MIN_DOCS, MIN_LIFT, MIN_Z = 5, 4.0, 6.0
#: Occurrences in one document that count, lengths of word beginnings that may stand for all their forms, and different
#: forms that toxic documents must have.
CAPPED, STEMS, MIN_FORMS = 5, range(4, 9), 3
THRESHOLD = 0.7
#: Terms that a task counts before it hands on what it has.
HELD = 60_000
WORD = regex.compile(r"\p{L}+")


def _folded(c: str) -> str:
    """What a character counts as; nothing if it can't be seen."""
    if unicodedata.category(c) == "Cf":
        return ""
    c = unicodedata.normalize("NFKD", c).casefold()
    return "".join(LOOK_ALIKE.get(x, x) for x in c if not unicodedata.combining(x)) or " "


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _folded(chr(code))
        return out


FOLD = _Fold()
DIGITS = str.maketrans(SIGNS)
SIGNED = re.compile(r"(?<!\S)[^\s013457@$!]*+[013457@$!]\S*")
BESIDE = regex.compile(r"\p{L}[013457@$!]|[013457@$!]\p{L}")


#: Stands in _ones() for what can't be seen.
UNSEEN = "\x01"


@functools.cache
def _ones() -> np.ndarray:
    """Code points that fold to one other, in a row; 0 where a code point folds to several, UNSEEN where to none."""
    codes = np.zeros(0x110000, "<u4")
    for c in itertools.chain(range(1, 0xD800), range(0xE000, 0x20000)):
        out = _folded(chr(c))
        if len(out) < 2:
            codes[c] = ord(out or UNSEEN)
    return codes


def _spelled(m: re.Match) -> str:
    """A piece with signs and digits; they count as letters where one stands beside a letter, but for marks at the end."""
    piece = m[0]
    body = piece.rstrip("!")
    if body.isalpha():
        return body + " " * (len(piece) - len(body))
    return body.translate(DIGITS) + " " * (len(piece) - len(body)) if BESIDE.search(piece) else piece


def fold(text: str) -> str:
    """Case, look-alike letters and signs folded, unseen characters left out; a sign or digit counts as a letter only within a word that has letters.

    A one may stand for i or l, so that all three become i.
    """
    if text.isascii():
        low = text.lower()
    else:
        text = text.replace("ß", "ss")
        codes = _ones()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        low = (codes.tobytes().decode("utf-32-le") if codes.all() else text.translate(FOLD)).replace(UNSEEN, "")
    return SIGNED.sub(_spelled, low).replace("l", "i")


@dataclass(frozen=True)
class Model:
    """Weights of folded terms, exception phrases, the bias and the coefficients of features().

    A term with a star at its end stands for every word that begins so, others for whole words.
    """

    weights: tuple[tuple[str, float], ...]
    phrases: tuple[str, ...]
    bias: float
    slopes: tuple[float, ...]


@functools.lru_cache(4)
def automaton(weights: tuple[tuple[str, float], ...], phrases: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for term, w in weights:
        stem = fold(term.rstrip("*"))
        a.add_word(stem, (len(stem), w, term[-1] != "*"))
    for p in map(fold, phrases):
        a.add_word(p, (len(p), None, True))
    if len(a):
        a.make_automaton()
    return a


def matches(text: str, weights, phrases) -> tuple[int, float]:
    """How many whole-word terms a text has outside exception phrases, and their weight."""
    a, folded = automaton(weights, phrases), fold(text)
    if not len(a):
        return 0, 0.0
    found, shields = [], []
    for end, (size, w, whole) in a.iter(folded):
        start = end - size + 1
        if (start and folded[start - 1].isalpha()) or (whole and end + 1 < len(folded) and folded[end + 1].isalpha()):
            continue
        (found if w is not None else shields).append((start, end, w))
    if shields and found:
        # the furthest end of the phrases that begin no later than each one
        shields.sort()
        begins = [s for s, _, _ in shields]
        ends = list(itertools.accumulate((e for _, e, _ in shields), max))
        found = [x for x in found if not ((k := bisect.bisect_right(begins, x[0])) and x[1] <= ends[k - 1])]
    return len(found), sum(w for _, _, w in found)


def features(text: str, weights, phrases) -> tuple[tuple[float, float, float], int]:
    """Figures from 0 to 1: the weight of all matches, that weight for the root of the words and for the words; and the matches."""
    n, total = matches(text, weights, phrases)
    size = text.count(" ") + text.count("\n") + 1
    return (min(1.0, math.log1p(total) / 5), min(1.0, total / math.sqrt(size) / 4), min(1.0, 5 * total / size)), n


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """At most about MAX_LABELLED rows (text, toxic), none of them held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(crc_mod(F.col("doc_id"), 3) != 1)
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, MAX_LABELLED / max(n, 1)))).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    # the sample has a fixed bound, whatever the tables
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    # copies and most near copies share their least shingle: each passage teaches once
    words = F.array(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    # an array of one: the words are split once, not for each shingle
    least = F.get(F.transform(words, lambda ws: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, 3))))), 0)
    own = rows.groupBy(F.col("_toxic").alias("toxic"), least.alias("_least")).agg(F.min("text").alias("text"))
    return materialize(own.select("text", "toxic"), "labelled")


def _counts(terms_of):
    """Documents and occurrences of a term in each class, summed up in each task; terms_of counts the terms of a text's words."""

    def counted(rows):
        docs, times = Counter(), Counter()
        for b in rows:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = text.as_py()
                for w, k in terms_of(WORD.findall(fold(text or ""))).items():
                    docs[w, toxic] += 1
                    times[w, toxic] += k
                if len(docs) > HELD:
                    yield _batch(docs, times)
                    docs.clear(), times.clear()
        if docs:
            yield _batch(docs, times)

    return counted


def _batch(docs: Counter, times: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": [t for t, _ in docs], "toxic": pa.array([c for _, c in docs], pa.int32()), "n": pa.array(docs.values(), pa.int64()), "k": pa.array(times.values(), pa.int64())})


def _words_and_stems(words: list[str]) -> dict[str, int]:
    own = Counter(words)
    for w, k in list(own.items()):
        for m in STEMS:
            if len(w) > m:
                own[w[:m] + "*"] += k
    return {**{w: min(k, CAPPED) for w, k in own.items()}, "": len(words)}


def _sums(rows: DataFrame, terms_of) -> DataFrame:
    """(term, t, f, kt, kf): documents and occurrences, toxic and not."""
    each = rows.mapInArrow(frugal(_counts(terms_of)), "term string, toxic int, n long, k long")
    return each.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col(x))), F.lit(0)).alias(a) for x, c, a in (("n", 1, "t"), ("n", 0, "f"), ("k", 1, "kt"), ("k", 0, "kf"))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn a model from a bounded sample of labelled rows that aren't held out (crc32 of the id modulo 3 is not 1)."""
    rows = labelled(docs, labels, id_col, text_col)
    every = materialize(_sums(rows, _words_and_stems), "terms")
    total = every.where("term = ''").first()
    t, f = (total["t"], total["f"]) if total else (0, 0)
    if not t or not f:
        return Model((), PHRASES, math.log((t + 0.5) / (f + 0.5)), (1.0, 4.0, 4.0))
    share = (total["kt"] + 1) / (total["kt"] + total["kf"] + 2)
    k = F.col("kt") + F.col("kf")
    z = (F.col("kt") - k * share) / F.sqrt(k * share * (1 - share))
    lift = (F.col("kt") + 0.5) / (F.col("kf") + 0.5) * ((1 - share) / share)
    terms = every.where((F.col("t") >= MIN_DOCS) & (lift >= MIN_LIFT) & (z >= MIN_Z) & (F.col("term") != "")).select("term", F.log(lift).alias("w"), z.alias("z"))
    stems = terms.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("stem"))
    forms = every.where((F.col("t") > 0) & ~F.endswith("term", F.lit("*"))).select(F.col("term").alias("form"), F.explode(F.array(*[F.concat(F.substring("term", 1, k), F.lit("*")) for k in STEMS])).alias("stem"))
    varied = forms.join(stems, "stem").groupBy("stem").agg(F.countDistinct("form").alias("n")).where(F.col("n") >= MIN_FORMS)
    varied = {r["stem"] for r in varied.collect()}
    found = [r for r in terms.orderBy(F.desc("z"), "term").collect() if r["term"][-1] != "*" or r["term"] in varied]
    weights = tuple(sorted((r["term"], r["w"]) for r in _apart(found)))
    known = {w for w, _ in weights}
    beside = _sums(rows, lambda words: Counter(f"{a} {b}" for a, b in itertools.pairwise(words) if a in known or b in known))
    mild = beside.where((F.col("t") + F.col("f") >= MIN_DOCS) & (F.col("t") / (F.col("t") + F.col("f")) < 1.5 * t / (t + f)))
    phrases = tuple(sorted({*PHRASES, *(r["term"] for r in mild.collect())}))

    def points(batches):
        for b in batches:
            x = [(features(text.as_py() or "", weights, phrases)[0], toxic) for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            c = Counter((*(round(v, 2) for v in p), y) for p, y in x)
            yield pa.RecordBatch.from_pydict({"x": pa.array([k[:-1] for k in c], pa.list_(pa.float64())), "y": pa.array([k[-1] for k in c], pa.int32()), "n": pa.array(c.values(), pa.int64())})

    # no more rows than the sample has, and features are rounded to hundredths
    grid = rows.mapInArrow(frugal(points), "x array<double>, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    bias, *slopes = _logistic(np.array([(1, *r["x"]) for r in grid]), np.array([r["y"] for r in grid], float), np.array([r["n"] for r in grid], float))
    return Model(weights, phrases, bias, tuple(slopes))


def _apart(terms: list) -> list:
    """Terms in order less those that cover, or are covered by, one before them."""
    stems, parts, out = set(), set(), []
    for r in terms:
        word, many = r["term"].rstrip("*"), r["term"][-1] == "*"
        own = {word[:k] for k in STEMS if k < len(word) + (not many)}
        if own & stems or (many and word in parts):
            continue
        out.append(r)
        parts |= own
        if many:
            stems.add(word)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.05) -> list[float]:
    """Newton's method on the weighted log-loss with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta)), x.T @ (n * (y - p)) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def score(text: Column, model: Model) -> Column:
    """struct<score: double, n_matches: int>, the score from 0 to 1. A null text counts as empty; long texts are read whole."""
    m = model

    @F.arrow_udf("struct<score: double, n_matches: int>")
    def scored(texts: pa.Array) -> pa.Array:
        x = [features(t.as_py() or "", m.weights, m.phrases) for t in texts]
        s = [1 / (1 + math.exp(-max(-30.0, min(30.0, m.bias + sum(a * b for a, b in zip(m.slopes, p, strict=True)))))) for p, _ in x]
        release()
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array([n for _, n in x], pa.int32())], ["score", "n_matches"])

    return scored(text.cast("string"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of docs with toxicity, n_toxic and toxic (at THRESHOLD), which replace such columns of docs.

    Repeated rows are scored one by one. An empty table gives no rows. Without labels the lexicon is empty and every score
    the base share.
    """
    return docs.withColumn("_toxicity", score(F.col(text_col), model)).select(
        *[c for c in docs.columns if c not in ("toxicity", "n_toxic", "toxic")],
        F.col("_toxicity.score").alias("toxicity"),
        F.col("_toxicity.n_matches").alias("n_toxic"),
        (F.col("_toxicity.score") >= THRESHOLD).cast("int").alias("toxic"),
    )
