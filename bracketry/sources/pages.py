"""Pages as tables: one pass over a page's tags gives nested rows, and each kind of page is a few expressions over them.

`with_page` adds the struct page (tables, items, headings); all else is DataFrame and Column functions over it. Null pages have
no tables, items or headings. A row of a table keeps its place, whatever else the page has.

`page_rounds` and `page_matchups` read the rows of `round_stats` and `odds_grid` out of whole batches of pages (`pagebatch.py`): a
page becomes neither Python objects nor one row of Spark's, and what it gives is not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.odds import american_to_decimal
from ..functions.text import clock_seconds, landed_of_attempted
from .pagebatch import Tables, groups, read_tables
from .tagstream import read_page

LINK = "array<struct<href: string, text: string>>"
CELL = f"struct<col: int, rowspan: int, colspan: int, head: boolean, class: string, data: map<string, string>, text: string, parts: array<string>, links: {LINK}>"
TABLE = f"struct<table: int, parent: int, id: string, class: string, rows: array<struct<section: string, class: string, cells: array<{CELL}>>>>"
PAGE = f"struct<tables: array<{TABLE}>, items: array<struct<class: string, text: string, links: {LINK}>>, headings: array<struct<level: int, class: string, text: string, source: string>>>"


#: Links, classes, attributes and phrases of the pages that are read, and the columns of their tables of rounds.
MATCHUP_LINK, SIDE_LINK, JUDGE_LINK = "/cnadm/matchups/", "/fighters/", "judge/"
TOP_CELL, LIST_CELL, SCORE_ROW, BOOK, PRICED = "top-cell", "list", "decision", "data-b", "data-li"
ROUND_ROW = r"Round\s*(\d+)"
WAYS = r"(?i)^(.+?)\s+wins\s+by\s+(TKO/KO|KO/TKO|submission|decision)\s*$"
MAIN = ["kd", "sig", "sig_share", "total", "td", "td_share", "sub", "rev", "control"]
ZONES = ["sig", "sig_share", "head", "body", "leg", "distance", "clinch", "ground"]


#: Letters of pages that are held as Python objects at once, unless one page has more.
LETTERS = 2_000_000


def _stretches(html: pa.Array) -> list[int]:
    """Ends of stretches of pages with so many letters."""
    ends, held = [], 0
    for i, n in enumerate(pc.binary_length(html).to_pylist()):
        if held and held + (n or 0) > LETTERS:
            ends.append(i)
            held = 0
        held += n or 0
    return [*ends, len(html)] if len(html) else ends


def with_page(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with page; a column of that name is replaced."""
    kind = to_arrow_type(_parse_datatype_string(PAGE))

    @F.arrow_udf(PAGE)
    def page_of(html: pa.Array) -> pa.Array:
        made, at = [], 0
        for to in _stretches(html):
            made.append(pa.array([read_page(t.as_py() or "") for t in html[at:to]], kind))
            at = to
        return pa.concat_arrays(made) if made else pa.array([], kind)

    # else Spark asks for tables before it lists them, and reads each page twice
    return df.withColumn("page", page_of.asNondeterministic()(F.col(html_col).cast("string")))


def table_rows(df: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """(keys, table, parent, table_class, row, section, row_class, cells) of a df with page; keep is a condition on x, a table."""
    tables = df.select(*keys, F.explode("page.tables").alias("x"))
    tables = tables.where(keep) if keep is not None else tables
    rows = tables.select(*keys, "x.table", "x.parent", F.col("x.class").alias("table_class"), F.posexplode("x.rows").alias("row", "r"))
    return rows.select(*keys, "table", "parent", "table_class", "row", F.col("r.section").alias("section"), F.col("r.class").alias("row_class"), F.col("r.cells").alias("cells"))


def grid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table, row, col, text): every place of a table's grid that a cell covers, none below its last row."""
    last = F.max("row").over(Window.partitionBy(*keys, "table"))
    each = rows.withColumn("_last", last).select(*keys, "table", "row", "_last", F.explode("cells").alias("c"))
    down = F.sequence(F.col("row"), F.least(F.col("row") + F.col("c.rowspan") - 1, F.col("_last")))
    tall = each.select(*keys, "table", F.explode(down).alias("row"), "c")
    return tall.select(*keys, "table", "row", F.explode(F.sequence(F.col("c.col"), F.col("c.col") + F.col("c.colspan") - 1)).alias("col"), F.col("c.text").alias("text"))


def _named(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lower(c["text"]).alias("name"), c["col"].alias("col")))


def records(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, table, row, one struct<text, parts, links> a name) of tables with a row that heads all these columns, in any order.

    Names are compared in lower case; the first such row heads the rows after it. A row without a cell in a column has null.
    """
    wanted = [n.lower() for n in names]
    heads = lambda r: F.forall(F.array(*map(F.lit, wanted)), lambda n: F.exists(r["cells"], lambda c: F.lower(c["text"]) == n))
    t = df.select(*keys, F.explode("page.tables").alias("x")).where(F.exists("x.rows", heads))
    at = F.array_min(F.transform(F.filter(F.transform("x.rows", lambda r, i: F.struct(i.alias("i"), heads(r).alias("h"))), lambda s: s["h"]), lambda s: s["i"]))
    t = t.withColumn("_at", at).withColumn("_head", _named(F.get("x.rows", F.col("_at"))["cells"]))
    rows = t.select(*keys, "x.table", "_at", "_head", F.posexplode("x.rows").alias("row", "r")).where("row > _at")

    def cell(n: str) -> Column:
        col = F.get(F.filter("_head", lambda h: h["name"] == n), F.lit(0))["col"]
        c = F.get(F.filter("r.cells", lambda c: (c["col"] <= col) & (col < c["col"] + c["colspan"])), F.lit(0))
        return F.when(c.isNotNull(), F.struct(c["text"].alias("text"), c["parts"].alias("parts"), c["links"].alias("links")))

    return rows.select(*keys, "table", "row", *[cell(w).alias(n) for w, n in zip(wanted, names, strict=True)])


def marked(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Rows of table_rows() with mark, the number in the last row of one cell before them that has pattern; such rows go."""
    only = F.when(F.size("cells") == 1, F.regexp_extract(F.get("cells", F.lit(0))["text"], pattern, 1))
    number = F.when(only != "", only.try_cast("int"))
    own = Window.partitionBy(*keys, "table").orderBy("row")
    told = rows.withColumns({"_mark": number, "mark": F.last(number, ignorenulls=True).over(own)})
    return told.where("_mark is null").drop("_mark")


def round_stats(df: DataFrame, keys: list[str], id_pattern: str = r"([^/]+)/?$") -> DataFrame:
    """A row a round and side of pages with two tables of rounds: the first with ten columns of totals, the second with nine of zones.

    A round begins with a row "Round n"; a cell has a line for each side, and the first one links to both. Rows with fewer cells
    or links are left out, and missing figures are 0, as is the second table of a side that has none. A page with one such table
    alone has no rounds.
    """
    heads = F.exists("x.rows", lambda r: (F.size(r["cells"]) == 1) & F.get(r["cells"], F.lit(0))["text"].rlike(ROUND_ROW))
    rows = marked(table_rows(df, keys, heads), keys, ROUND_ROW).where("mark is not null")
    at = Window.partitionBy(*keys).orderBy("table")
    rows = rows.withColumns({"_nth": F.dense_rank().over(at), "_n": F.size(F.collect_set("table").over(Window.partitionBy(*keys)))}).where("_n >= 2 and _nth <= 2")
    enough = F.size("cells") >= F.when(F.col("_nth") == 1, 10).otherwise(9)
    rows = rows.where(enough & (F.size(F.get("cells", F.lit(0))["links"]) >= 2))
    sides = rows.select(*keys, F.col("mark").alias("round"), "_nth", "cells", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    line = lambda i: F.get(F.get("cells", F.lit(i))["parts"], F.col("side"))
    who = F.regexp_extract(F.get(F.get("cells", F.lit(0))["links"], F.col("side"))["href"], id_pattern, 1)
    first = {n: line(i) for i, n in enumerate(MAIN, 1)}
    second = {n: line(i) for i, n in enumerate(ZONES, 1)}
    whole = lambda c: F.coalesce(F.regexp_replace(c, r"\s", "").try_cast("int"), F.lit(0))
    of = lambda c, k: F.coalesce(landed_of_attempted(c)[k], F.lit(0))
    figures = {"knockdowns": (1, whole(first["kd"])), "submissions": (1, whole(first["sub"])), "reversals": (1, whole(first["rev"])), "control": (1, F.coalesce(clock_seconds(first["control"]), F.lit(0)))}
    for n, c in (("sig", first["sig"]), ("total", first["total"]), ("takedowns", first["td"])):
        figures |= {f"{n}_{k}": (1, of(c, k)) for k in ("landed", "attempted")}
    for n in ZONES[2:]:
        figures |= {f"{n}_{k}": (2, of(second[n], k)) for k in (("landed", "attempted") if n in ("head", "body", "leg") else ("landed",))}
    told = sides.withColumn("who", who).where("who <> ''")
    return told.groupBy(*keys, "round", "who").agg(*[F.coalesce(F.max(F.when(F.col("_nth") == k, c)), F.lit(0)).alias(n) for n, (k, c) in figures.items()], F.min("side").alias("side"))


def labelled(df: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """(keys, one text a label) from items "Label: value"; the first item with a label counts, "--" and nothing are null."""

    def value(label: str) -> Column:
        found = F.get(F.filter("page.items", lambda i: F.startswith(F.lower(i["text"]), F.lit(label.lower() + ":"))), F.lit(0))["text"]
        text = F.trim(F.substring(found, len(label) + 2, 1 << 30))
        return F.when(~text.isin("", "--"), text)

    return df.select(*keys, *[value(label).alias(name) for name, label in labels.items()])


def cards(df: DataFrame, keys: list[str], judge: str = JUDGE_LINK) -> DataFrame:
    """(keys, table, judge, a, b, round, score_a, score_b) of tables that link to a judge.

    The first row with two cells of the class top-cell names the sides; rows of the class decision have a round and two scores
    in cells of the class list. Rows without whole numbers are left out.
    """
    has = lambda cls, name: F.array_contains(F.split(cls, r"\s+"), name)
    links = F.flatten(F.flatten(F.transform("x.rows", lambda r: F.transform(r["cells"], lambda c: c["links"]))))
    own = F.filter(links, lambda a: F.startswith(a["href"], F.lit(judge)))
    tops = F.filter(F.transform("x.rows", lambda r: F.filter(r["cells"], lambda c: has(c["class"], TOP_CELL))), lambda c: F.size(c) >= 2)
    side = lambda i: F.lower(F.regexp_replace(F.get(F.get(tops, F.lit(0)), F.lit(i))["text"], "[^A-Za-z]", ""))
    t = df.select(*keys, F.explode("page.tables").alias("x")).select(*keys, "x", F.get(own, F.lit(0))["text"].alias("judge"), side(0).alias("a"), side(1).alias("b"))
    rows = t.where("judge is not null and a <> '' and b <> ''").select(*keys, "x.table", "judge", "a", "b", F.explode("x.rows").alias("r"))
    lists = F.filter("r.cells", lambda c: has(c["class"], LIST_CELL))
    score = lambda i: F.get(lists, F.lit(i))["text"].try_cast("int")
    out = rows.where(has(F.col("r.class"), SCORE_ROW)).select(*keys, "table", "judge", "a", "b", score(0).alias("round"), score(1).alias("score_a"), score(2).alias("score_b"))
    return out.dropna(subset=["round", "score_a", "score_b"])


def odds_grid(df: DataFrame, keys: list[str], start: str = MATCHUP_LINK, who: str = SIDE_LINK) -> DataFrame:
    """(keys, table, matchup, place, label, who, book, price): a row a price in tables of rows for each side and columns for books.

    A row whose head cell links to start and to who is side 0 of a matchup, and the row after it side 1 if its head links to who;
    rows that follow up to the next link are propositions (place 2 and on) with their label. A head cell's data-b numbers a book;
    a price cell's data-li begins with the book's number, and its text with an American price, given back as a decimal; cells
    without one give no row. Rows before the first matchup, and matchups without a second side, are left out.
    """
    books = F.filter(F.flatten(F.transform("x.rows", lambda r: r["cells"])), lambda c: F.element_at(c["data"], BOOK).isNotNull())
    named = F.transform(books, lambda c: F.struct(F.element_at(c["data"], BOOK).alias("b"), F.coalesce(F.get(c["links"], F.lit(0))["text"], c["text"]).alias("name")))
    t = df.select(*keys, F.explode("page.tables").alias("x")).select(*keys, "x", named.alias("books")).where(F.size("books") > 0)
    rows = t.select(*keys, "x.table", "books", F.posexplode("x.rows").alias("row", "r"))
    head = F.get(F.filter("r.cells", lambda c: c["head"] & F.element_at(c["data"], BOOK).isNull()), F.lit(0))
    link = lambda prefix: F.get(F.filter(head["links"], lambda a: F.startswith(a["href"], F.lit(prefix))), F.lit(0))
    told = rows.select(*keys, "table", "row", "books", "r.cells", head["text"].alias("label"), link(start)["href"].alias("_start"), link(who)["href"].alias("_who"), link(who)["text"].alias("name")).where("label is not null")
    own = Window.partitionBy(*keys, "table").orderBy("row")
    begins = F.col("_start").isNotNull() & F.col("_who").isNotNull()
    told = told.withColumn("_nth", F.sum(F.when(begins, 1).otherwise(0)).over(own)).where("_nth > 0")
    within = Window.partitionBy(*keys, "table", "_nth")
    # a later link to a side ends a matchup's rows without beginning another
    told = told.withColumn("place", F.row_number().over(within.orderBy("row")) - 1)
    told = told.withColumns({"matchup": F.regexp_extract(F.first("_start").over(within.orderBy("row")), r"(\d+)/?$", 1), "_stray": F.max(F.when((F.col("place") > 1) & F.col("_who").isNotNull(), 1).otherwise(0)).over(within.orderBy("row")), "_two": F.max(F.when((F.col("place") == 1) & F.col("_who").isNotNull(), 1).otherwise(0)).over(within)})
    kept = told.where("_two = 1 and _stray = 0 and matchup <> ''")
    cells = kept.select(*keys, "table", "matchup", "place", "label", F.coalesce("name", F.lit("")).alias("who"), "books", F.explode("cells").alias("c"))
    book = F.regexp_extract(F.element_at("c.data", PRICED), r'^\[\s*"?(\d+)', 1)
    found = cells.withColumns({"_book": F.get(F.filter("books", lambda b: b["b"] == book), F.lit(0))["name"], "_price": F.regexp_extract("c.text", r"^([+\-]?\d+)(?:$|[^\d.,/%])", 1).try_cast("int")})
    priced = found.where(F.col("_book").isNotNull()).select(*keys, "table", "matchup", "place", "label", "who", F.col("_book").alias("book"), american_to_decimal(F.col("_price")).alias("price"))
    return priced.where("price is not null")


def consensus(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table, matchup, a, b, best_a, best_b, median_a, median_b, n_a, n_b, methods) of odds_grid(): a row a matchup.

    methods maps a_ko, b_dec and so on to the median of the proposition "Name wins by method", if the name's words are all
    in one side's name and not in the other's; of several the first row counts.
    """
    per = grid_.groupBy(*keys, "table", "matchup", "place", "label", "who").agg(F.collect_list("price").alias("prices"))
    return consensus_of_places(per.groupBy(*keys, "table", "matchup").agg(F.collect_list(F.struct("place", "label", "who", "prices")).alias("places")), keys)


def consensus_of_places(d: DataFrame, keys: list[str]) -> DataFrame:
    """consensus() of a row a matchup with its places, an array of (place, label, who, prices)."""
    at = lambda c, i: F.get(c, i.cast("int"))
    middle = lambda c: 0.5 * at(c, F.floor((F.size(c) - 1) / 2)) + 0.5 * at(c, F.floor(F.size(c) / 2))
    told = d.withColumn("_p", F.transform("places", lambda p: F.struct(p["place"].alias("place"), p["label"].alias("label"), p["who"].alias("who"), F.array_sort(p["prices"]).alias("sorted"))))
    told = told.withColumn("_p", F.transform("_p", lambda p: F.struct(p["place"].alias("place"), p["label"].alias("label"), p["who"].alias("who"), F.array_max(p["sorted"]).alias("best"), middle(p["sorted"]).alias("median"), F.size(p["sorted"]).alias("n"))))
    told = told.withColumns({"_0": F.filter("_p", lambda p: p["place"] == 0), "_1": F.filter("_p", lambda p: p["place"] == 1), "_props": F.array_sort(F.transform(F.filter("_p", lambda p: p["place"] > 1), lambda p: F.struct(p["place"], p["label"], p["median"].alias("mid"))))})
    most = lambda i, name: F.array_max(F.col(f"_{i}")[name])
    one = told.select(*keys, "table", "matchup", most(0, "who").alias("a"), most(1, "who").alias("b"), *[most(i, n).alias(f"{n}_{s}") for n in ("best", "median", "n") for i, s in ((0, "a"), (1, "b"))], "_props")
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")

    def key(p: Column) -> Column:
        name, how = words(F.regexp_extract(p["label"], WAYS, 1)), F.lower(F.regexp_extract(p["label"], WAYS, 2))
        of = lambda c: F.size(F.array_except(name, words(F.coalesce(F.col(c), F.lit(""))))) == 0
        sides = F.when(of("a") & ~of("b"), "a_").when(of("b") & ~of("a"), "b_")
        return F.when(p["label"].rlike(WAYS), F.concat(sides, F.when(how == "submission", "sub").when(how == "decision", "dec").otherwise("ko")))

    one = one.withColumn("_keyed", F.filter(F.transform("_props", lambda p: F.struct(key(p).alias("k"), p["mid"].alias("v"))), lambda x: x["k"].isNotNull()))
    once = F.filter(F.transform("_keyed", lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), F.exists(F.slice("_keyed", 1, i), lambda y: y["k"] == x["k"]).alias("again"))), lambda x: ~x["again"])
    return one.withColumn("methods", F.map_from_entries(F.transform(once, lambda x: F.struct(x["k"], x["v"])))).drop("_props", "_keyed")


def _batches(df: DataFrame, keys: list[str], html_col: str, kinds: str, told: Callable[[Tables], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """keys and what told gives for each page's tables: the pages of its rows, and their columns."""
    fields = to_arrow_type(_parse_datatype_string(f"struct<{kinds}>"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, at = batch.column(len(keys)), 0
            for to in _stretches(html):
                for tables in read_tables(html[at:to]):
                    page, columns = told(tables)
                    own = [batch.column(i).take(pa.array(page + at)) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays(own + [c.cast(f.type) for c, f in zip(columns, fields, strict=True)], names=[*keys, *(f.name for f in fields)])
                at = to

    own = df.select(*keys, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + [kinds])
    return own.mapInArrow(read, schema)


def _by_value(texts: pa.Array, value: Callable[[str], int]) -> np.ndarray:
    """value of each text, asked once for equal ones."""
    coded = texts.dictionary_encode()
    return np.array([value(t) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(texts) else np.zeros(0, np.int64)


def _codes(texts: np.ndarray) -> np.ndarray:
    return pa.array(texts, pa.large_string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(text: str, otherwise: int = 0) -> int:
    """A whole number as Spark casts it."""
    m = re.match(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*\Z", text)
    return int(m[1]) if m and len(m[1]) < 100 and -(1 << 31) <= int(m[1]) < 1 << 31 else otherwise


def _spaced(text: str) -> int:
    return _whole(re.sub(r"\s", "", text, flags=re.ASCII))


def _clock(text: str) -> int:
    m = re.match(r"([0-9]+):([0-5][0-9])\Z", text)
    return _whole(m[1]) * 60 + int(m[2]) if m else 0


def _of(k: int) -> Callable[[str], int]:
    def value(text: str) -> int:
        m = re.match(r"([0-9]+) of ([0-9]+)\Z", text)
        return _whole(m[k]) if m else 0

    return value


#: Figures of a side's round: which table and line they are in, and how they are read.
FIGURES = {n: (1, 1 + MAIN.index(c), f) for n, c, f in (("knockdowns", "kd", _spaced), ("submissions", "sub", _spaced), ("reversals", "rev", _spaced), ("control", "control", _clock))}
FIGURES |= {f"{n}_{w}": (1, 1 + MAIN.index(c), _of(k)) for n, c in (("sig", "sig"), ("total", "total"), ("takedowns", "td")) for k, w in ((1, "landed"), (2, "attempted"))}
FIGURES |= {f"{n}_{w}": (2, 1 + ZONES.index(n), _of(k)) for n in ZONES[2:] for k, w in ((1, "landed"), (2, "attempted")) if k == 1 or n in ("head", "body", "leg")}


def page_rounds(df: DataFrame, keys: list[str], html_col: str = "html", id_pattern: str = r"([^/]+)/?$", figures: list[str] | None = None) -> DataFrame:
    """round_stats() of pages as they are written, with these figures alone if they are given."""
    figures = list(FIGURES) if figures is None else figures
    ids, mark_of = re.compile(id_pattern, re.ASCII), re.compile(ROUND_ROW, re.ASCII)

    def mark(text: str) -> int:
        m = mark_of.search(text)
        return _whole(m[1], -1) if m else -1

    def whose(attrs: dict) -> str:
        m = ids.search(attrs["href"])
        return (m[1] or "") if m else ""

    def told(t: Tables) -> tuple[np.ndarray, list[pa.Array]]:
        # the rows after a mark, and the first two tables with such rows
        alone, marks, i = np.flatnonzero(t.cells_of_row == 1), np.full(len(t.row_table), -1), np.arange(len(t.row_table))
        marks[alone] = _by_value(t.texts(t.first_cell[alone]), mark)
        last = np.maximum.accumulate(np.where(marks >= 0, i, -1)) if len(i) else i
        rows = np.flatnonzero((marks < 0) & (last >= groups(t.row_table)[0]))
        tables = np.unique(t.row_table[rows])
        pages = t.table_page[tables]
        nth = np.full(len(t.table_page), 9)
        begin, end = groups(pages)
        nth[tables] = 1 + np.arange(len(tables)) - begin
        nth[tables[end - begin < 2]] = 9
        nth = nth[t.row_table[rows]]
        enough = np.where(nth == 1, 10, 9)
        rows, nth = (x[(nth <= 2) & (t.cells_of_row[rows] >= enough)] for x in (rows, nth))
        linked = t.links[t.first_cell[rows]] >= 2
        rows, nth, side = np.repeat(rows[linked], 2), np.repeat(nth[linked], 2), np.tile([0, 1], int(linked.sum()))
        who = t.each(whose, t.link_attr[t.first_link[t.first_cell[rows]] + side])
        own = who.astype(bool)
        rows, nth, side, who = rows[own], nth[own], side[own], who[own]
        # a round and side is in order with all that tells of it
        page, number, name = t.table_page[t.row_table[rows]], marks[last[rows]], _codes(who)
        order = np.lexsort((name, number, page))
        rows, nth, side, who, page, number, name = (x[order] for x in (rows, nth, side, who, page, number, name))
        new = np.ones(len(rows), bool)
        new[1:] = (page[1:] != page[:-1]) | (number[1:] != number[:-1]) | (name[1:] != name[:-1])
        begins = np.flatnonzero(new)
        # lines of the two tables; a side without a line has an empty one
        of_table = {k: np.flatnonzero(nth == k) for k in (1, 2)}
        lines, most = {}, []
        for k, line, value in (FIGURES[n] for n in figures):
            at = of_table[k]
            if (k, line) not in lines:
                cell = t.first_cell[rows[at]] + line
                piece = np.where(side[at] < t.pieces[cell], t.first_piece[cell] + side[at], len(t.piece_at))
                lines[k, line] = t.strings(np.append(t.piece_at, 0)[piece], np.append(t.piece_size, 0)[piece])
            got = np.full(len(rows), -(1 << 40))
            got[at] = _by_value(lines[k, line], value)
            got = np.maximum.reduceat(got, begins) if len(rows) else got
            most.append(pa.array(np.where(got == -(1 << 40), 0, got)))
        least = np.minimum.reduceat(side, begins) if len(rows) else side
        return page[begins], [pa.array(number[begins]), pa.array(who[begins], pa.string()), *most, pa.array(least)]

    return _batches(df, keys, html_col, ", ".join(["round: int", "who: string", *(f"{n}: int" for n in figures), "side: int"]), told)


def page_matchups(df: DataFrame, keys: list[str], html_col: str = "html", start: str = MATCHUP_LINK, who: str = SIDE_LINK) -> DataFrame:
    """(keys, table, matchup, places) of pages as they are written, for consensus_of_places(): odds_grid() in a row a matchup, with prices of all books as Americans write them."""
    number, begins_with, price_of = re.compile(r"(\d+)/?$", re.ASCII), re.compile(r'^\[\s*"?(\d+)', re.ASCII), re.compile(r"^([+\-]?\d+)(?:$|[^\d.,/%])", re.ASCII)

    def price(text: str) -> int:
        m = price_of.search(text)
        return _whole(m[1]) if m else 0

    def first(pattern: re.Pattern, text: str) -> str:
        m = pattern.search(text)
        return m[1] if m else ""

    def told(t: Tables) -> tuple[np.ndarray, list[pa.Array]]:
        def of_attrs(value: Callable[[dict], str | None]) -> np.ndarray:
            got = np.empty(len(t.attrs) + 1, object)
            got[: len(t.attrs)] = [value(a) for a in t.attrs]
            return got

        starts = of_attrs(lambda a: first(number, a["href"]) if a.get("href", "").startswith(start) and "href" in a else None)
        whose = of_attrs(lambda a: "" if a.get("href", "").startswith(who) and "href" in a else None)
        book, priced = of_attrs(lambda a: a.get(BOOK)), of_attrs(lambda a: first(begins_with, a[PRICED]) if PRICED in a else None)
        table_of = t.row_table[t.cell_row]
        books = np.flatnonzero(np.not_equal(book, None)[t.cell_attr])
        booked = np.zeros(len(t.table_page), bool)
        booked[table_of[books]] = True
        # rows with a head cell that is no book's, in tables with books
        heads = np.flatnonzero(t.cell_head & ~np.not_equal(book, None)[t.cell_attr] & booked[table_of])
        rows, at = np.unique(t.cell_row[heads], return_index=True)
        heads = heads[at]

        def link_of(which: np.ndarray) -> np.ndarray:
            """The first such link of each head, or -1."""
            links = np.flatnonzero(np.not_equal(which, None)[t.link_attr])
            cells, at = np.unique(t.link_cell[links], return_index=True)
            k = np.minimum(np.searchsorted(cells, heads), max(len(cells) - 1, 0))
            return np.where(cells[k] == heads, links[at][k], -1) if len(cells) else np.full(len(heads), -1)

        began, named = link_of(starts), link_of(whose)
        # matchups: from a row with both links on
        i, table = np.arange(len(rows)), t.row_table[rows]
        block = np.maximum.accumulate(np.where((began >= 0) & (named >= 0), i, -1)) if len(i) else i
        block = np.where(block >= groups(table)[0], block, -1)
        place = i - block
        second = np.minimum(block + 1, max(len(i) - 1, 0))
        two = (block[second] == block) & (second > block) & (named[second] >= 0) if len(i) else i > 0
        stray = np.maximum.accumulate(np.where((place > 1) & (named >= 0), i, -1)) >= block if len(i) else i > 0
        matchup = starts[t.link_attr[began[block]]] if len(i) and len(t.link_attr) else np.empty(len(i), object)
        own = (block >= 0) & two & ~stray
        own[own] = matchup[own].astype(bool)
        rows, heads, place, matchup, table, named = (x[own] for x in (rows, heads, place, matchup, table, named))
        # prices of their cells
        row_at = np.full(len(t.row_table), -1)
        row_at[rows] = np.arange(len(rows))
        cells = np.flatnonzero((row_at[t.cell_row] >= 0) & np.not_equal(priced, None)[t.cell_attr])
        codes = _codes(np.concatenate([priced[t.cell_attr[cells]], book[t.cell_attr[books]]]))
        key = np.concatenate([table_of[cells], table_of[books]]) * (codes.max(initial=0) + 1) + codes
        cells = cells[np.isin(key[: len(cells)], key[len(cells) :])]
        prices = _by_value(t.texts(cells), price)
        cells, prices = (x[np.abs(prices) >= 100] for x in (cells, prices))
        n = np.bincount(row_at[t.cell_row[cells]], minlength=len(rows))
        # rows of a place, label and name of a matchup are one place
        label, name = t.texts(heads), t.strings(np.append(t.link_at, 0)[named], np.append(t.link_size, 0)[named])
        by = (table, _codes(matchup), place, *(x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (label, name)))
        order = np.lexsort(by[::-1])
        order = order[n[order] > 0]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in by[:2]:
            new[1:] |= x[order][1:] != x[order][:-1]
        matchups, place_begins = np.flatnonzero(new), new.copy()
        for x in by[2:]:
            place_begins[1:] |= x[order][1:] != x[order][:-1]
        places = np.flatnonzero(place_begins)
        rank = np.zeros(len(rows), np.int64)
        rank[order] = np.arange(len(order))
        prices = prices[np.argsort(rank[row_at[t.cell_row[cells]]], kind="stable")]
        price_ends = np.concatenate([[0], np.cumsum(n[order])])
        offsets = lambda x: pa.array(x.astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets(price_ends[np.append(places, len(order))]), pa.array(prices.astype(np.int32)))
        of_place = order[places]
        structs = pa.StructArray.from_arrays([pa.array(place[of_place].astype(np.int32)), label.take(pa.array(of_place)).cast(pa.string()), name.take(pa.array(of_place)).cast(pa.string()), lists], ["place", "label", "who", "prices"])
        grouped = pa.ListArray.from_arrays(offsets(np.searchsorted(places, np.append(matchups, len(order)))), structs)
        one = order[matchups]
        return t.table_page[table[one]], [pa.array(t.table_no[table[one]]), pa.array(matchup[one], pa.string()), grouped]

    return _batches(df, keys, html_col, "table: int, matchup: string, places: array<struct<place: int, label: string, who: string, prices: array<int>>>", told).withColumn("places", F.transform("places", lambda p: p.withField("prices", F.transform(p["prices"], american_to_decimal))))
