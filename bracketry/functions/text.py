"""Text functions: folding, similarity of names, parsing of units, dates, links and addresses. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿłđšžčćńśźżěřůßæœ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyldszccnszzerusao"


def fold(text: Column) -> Column:
    """Lower case without marks; all but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(fold(text), " ", "-")


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of every word, two blanks before it and one after."""
    words = F.filter(F.split(fold(text), " "), lambda w: w != "")
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the longer side."""
    x, y = (F.array_distinct(F.split(fold(c), " ")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edits for the longer text's length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(fold(text), " ")), " ")


def names_compatible(a: Column, b: Column) -> Column:
    """Same surname, and given names of which one starts the other; a name without a given name fits any."""
    x, y = F.split(fold(a), " "), F.split(fold(b), " ")
    given = lambda c: F.when(F.size(c) > 1, F.get(c, 0)).otherwise(F.lit(""))
    return (F.element_at(x, -1) == F.element_at(y, -1)) & (F.startswith(given(x), given(y)) | F.startswith(given(y), given(x)))


def low_quality(text: Column) -> Column:
    """Many sentences of some length, and most of them repeated."""
    long_ = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.char_length(s) > 15)
    return (F.size(long_) >= 10) & (F.size(F.array_distinct(long_)) / F.size(long_) < 0.4)


def strip_tags(page: Column) -> Column:
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def links(page: Column) -> Column:
    """Addresses of all anchors, in order."""
    return F.regexp_extract_all(page, F.lit(r'<a\s+[^>]*?href="([^"]*)"'), F.lit(1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def clock_seconds(text: Column) -> Column:
    """m:ss as seconds; null if it is none."""
    parts = F.regexp_extract(text, r"^(\d+):([0-5]\d)$", 1), F.regexp_extract(text, r"^(\d+):([0-5]\d)$", 2)
    return F.when(text.rlike(r"^\d+:[0-5]\d$"), parts[0].cast("int") * 60 + parts[1].cast("int"))


def landed_of_attempted(text: Column) -> Column:
    """"n of m" as a struct."""
    at = lambda k: F.regexp_extract(text, r"^(\d+) of (\d+)$", k).cast("int")
    return F.when(text.rlike(r"^\d+ of \d+$"), F.struct(at(1).alias("landed"), at(2).alias("attempted")))


def feet_inches_cm(text: Column) -> Column:
    at = lambda k: F.regexp_extract(text, r"^(\d+)' *(\d+)\"?$", k).cast("int")
    return F.when(text.rlike(r"^\d+' *\d+\"?$"), F.round((at(1) * 12 + at(2)) * 2.54).cast("int"))


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "MMM. d, yyyy")) -> Column:
    """The first format that fits; years before 1900 are placeholders and give null."""
    clean = F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1")
    found = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)).cast("date") for f in formats])
    return F.when(F.year(found) >= 1900, found)
