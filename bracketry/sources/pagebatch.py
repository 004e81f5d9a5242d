"""Tables of many pages at once: tags are found and told apart in numpy, over all letters of a stretch of pages.

A page is plain if its tables stand side by side without lists inside them, and if none of its comments, scripts and attributes
hides markup: its rows and cells follow from where its tags are. All other pages go through `read_page` and give the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tagstream import BREAKS, RAW, TAG, read_attributes, read_page

NONE, TABLE, END_TABLE, SECTION, END_SECTION, ROW, END_ROW, CELL, HEAD, END_CELL, PARAGRAPH, END_PARAGRAPH, BREAK, LINK, END_LINK, LIST, HIDDEN = range(17)
RAWS = sorted(RAW)
OPEN_RAW = 20
END_RAW = OPEN_RAW + len(RAWS)


def _codes() -> dict[str, int]:
    codes = {"table": TABLE, "/table": END_TABLE, "tr": ROW, "/tr": END_ROW, "td": CELL, "th": HEAD, "/td": END_CELL, "/th": END_CELL, "a": LINK, "/a": END_LINK}
    codes |= {t: SECTION for t in ("thead", "tbody", "tfoot")} | {f"/{t}": END_SECTION for t in ("thead", "tbody", "tfoot")}
    codes |= {e + t: BREAK for t in BREAKS for e in ("", "/")} | {"p": PARAGRAPH, "/p": END_PARAGRAPH}
    codes |= {e + t: LIST for t in ("ul", "ol", "li") for e in ("", "/")}
    return codes | {t: OPEN_RAW + i for i, t in enumerate(RAWS)} | {f"/{t}": END_RAW + i for i, t in enumerate(RAWS)}


CODES = _codes()
#: Tags without attributes of up to eight letters are told apart as whole numbers; those without a code have no part in tables.
_WORDS = sorted((int.from_bytes(t.encode(), "little"), len(t), c) for t, c in (dict.fromkeys(("span", "/span", "b", "/b", "i", "/i", "em", "/em", "strong", "/strong"), NONE) | CODES).items() if len(t) <= 8)
WORDS, SIZES, WORD_CODES = (np.array(c, t) for c, t in zip(zip(*_WORDS, strict=True), (np.uint64, np.int64, np.int64), strict=True))
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: The first two bytes of blanks beyond ASCII, and some others.
BLANKS = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)


def groups(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of equal ids begins and ends that each place is in."""
    turns = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(turns[1:], len(ids))[: len(turns)]
    return np.repeat(turns, ends - turns), np.repeat(ends, ends - turns)


def to_mend(letters: np.ndarray) -> np.ndarray:
    """Letters that text can't have if it is to stay as written, next to blanks at its ends."""
    blank, high = letters == 32, letters >= 128
    bad = (letters < 32) | (letters == 38)
    bad[1:] |= blank[1:] & blank[:-1]
    if high.any():
        i = np.flatnonzero(high[:-1] & high[1:])
        bad[i] |= np.isin((letters[i].astype(np.uint16) << 8) | letters[i + 1], BLANKS)
    return bad


def joined(at: np.ndarray, size: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The letters at these places, one place's after the other's."""
    ends = np.cumsum(size)
    return letters[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Tables:
    """Tables of pages in columns: tables, rows, cells, pieces of cells and links of cells, each in the order in which it begins.

    Texts are places in letters. A cell's attributes and a link's are numbers of attrs, -1 without any.
    """

    def __init__(self, letters, attrs, table_page, table_no, row_table, cell_row, cell_head, cell_attr, piece_cell, piece_at, piece_size, link_cell, link_attr, link_at, link_size):
        self.letters, self.attrs = letters, attrs
        self.table_page, self.table_no, self.row_table, self.cell_row, self.cell_head, self.cell_attr = table_page, table_no, row_table, cell_row, cell_head, cell_attr
        self.piece_at, self.piece_size, self.link_attr, self.link_at, self.link_size = piece_at, piece_size, link_attr, link_at, link_size
        self.cells_of_row = np.bincount(cell_row, minlength=len(row_table))
        self.first_cell = np.cumsum(self.cells_of_row) - self.cells_of_row
        self.pieces = np.bincount(piece_cell, minlength=len(cell_row))
        self.first_piece = np.cumsum(self.pieces) - self.pieces
        self.links = np.bincount(link_cell, minlength=len(cell_row))
        self.first_link = np.cumsum(self.links) - self.links
        self.piece_cell, self.link_cell = piece_cell, link_cell

    def strings(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(joined(at, size, self.letters))])

    def texts(self, cells: np.ndarray) -> pa.Array:
        """Whole texts of cells: their pieces that are not empty."""
        full = np.flatnonzero(self.piece_size > 0)
        begin, end = (np.searchsorted(self.piece_cell[full], cells, side) for side in ("left", "right"))
        one = np.append(full, 0)[begin]
        made = self.strings(np.where(end > begin, self.piece_at[one] if len(full) else 0, 0), np.where(end > begin, self.piece_size[one] if len(full) else 0, 0))
        several = np.flatnonzero(end - begin > 1)
        if len(several):
            words = made.to_pylist()
            for i in several.tolist():
                k = full[begin[i] : end[i]]
                words[i] = " ".join(self.strings(self.piece_at[k], self.piece_size[k]).to_pylist())
            made = pa.array(words, pa.large_string())
        return made

    def each(self, of_attr, ids: np.ndarray) -> np.ndarray:
        """of_attr of the attributes with these numbers, as objects; each number is asked once."""
        own, at = np.unique(ids, return_inverse=True)
        told = np.empty(len(own), object)
        told[:] = [of_attr(self.attrs[i] if i >= 0 else {}) for i in own.tolist()]
        return told[at]


#: Tags as most are written: small letters, values without references or quotes in them.
TIDY = re.compile(r"""<([a-z][a-z0-9]*)((?: [a-z-]+=(?:"[^"&>]*"|'[^'&>]*'|[^\s"'&>]+))+)>\Z""")
VALUES = re.compile(r"""([a-z-]+)=(?:"([^"]*)"|'([^']*)'|(\S+))""")


def _tag(source: bytes, attrs: list[dict]) -> tuple[int, int]:
    """Code of a tag as written up to the first ">", and the number of its attributes; HIDDEN if the tag does not end there."""
    text = source.decode()
    tidy = TIDY.match(text)
    if tidy:
        name, values = tidy.groups()
        found = {k: a or b or c for k, a, b, c in reversed(VALUES.findall(values))}
        if "href" in found:
            found["href"] = " ".join(found["href"].split())
        attrs.append(found)
        return CODES.get(name, NONE), len(attrs) - 1
    if text[1] in "!?":
        return (HIDDEN if text.startswith("<!--") and not (len(text) >= 7 and text.endswith("-->")) else NONE), -1
    m = TAG.match(text)
    # a value whose quote is open goes on to one of these
    found, end = read_attributes(text + "\"'>", m.end())
    if end != len(text) - 1:
        return HIDDEN, -1
    code = CODES.get(m.group(2) + m.group(3).lower(), NONE)
    if not found or m.group(2):
        return code, -1
    if "href" in found:
        found["href"] = " ".join(found["href"].split())
    attrs.append(found)
    return code, len(attrs) - 1


class _Texts:
    """Texts between tags, as they are written where that is the text, else mended and kept beside the letters."""

    def __init__(self, data: bytes, letters: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray, breaks: np.ndarray):
        self.data, self.letters, self.begin, self.end, self.is_break, self.breaks = data, letters, begin, end, breaks, np.concatenate([[0], np.cumsum(breaks)])
        self.has = (end > begin) & counts
        self.full, self.before = np.flatnonzero(self.has), np.concatenate([[0], np.cumsum(self.has)])
        a, b = begin[self.full], end[self.full]
        a = a + ((letters[a] == 32) & (b - a > 1))
        b = b - ((letters[b - 1] == 32) & (b - a > 1))
        self.inner, self.plain = (a, b), (letters[a] != 32) & (letters[b - 1] != 32)
        bad = np.flatnonzero(to_mend(letters))
        k = np.searchsorted(a, bad, "right") - 1
        self.plain[k[(k >= 0) & (bad < b[k])] if len(a) else []] = False
        self.kept, self.size, self.known = [], len(letters), {}

    def keep(self, got: bytes) -> tuple[int, int]:
        self.kept.append(got)
        self.size += len(got)
        return self.size - len(got), len(got)

    def of(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the text after the tags from first up to last."""
        begin, end = self.before[first], self.before[last]
        n = end - begin
        if not len(self.full):
            return np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        one = np.minimum(begin, len(self.full) - 1)
        a, b = (x[one] for x in self.inner)
        at, size = np.where(n > 0, a, 0), np.where(n > 0, b - a, 0)
        slow = (n == 1) & ~self.plain[one]
        several = np.flatnonzero(n > 1)
        if len(several):
            broken = self.breaks[last[several]] - self.breaks[first[several] + 1] > 0
            slow[several[broken]] = True
            at[several], size[several], fine = self.together(begin[several], n[several])
            slow[several[~fine]] = True
        slow = np.flatnonzero(slow)
        if len(slow):
            made = [self.mended(*x) for x in zip(first[slow].tolist(), last[slow].tolist(), strict=True)]
            at[slow], size[slow] = np.array(made, np.int64).T
        return at, size

    def together(self, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of n parts from begin on, put together, and whether that is the text."""
        ends = np.cumsum(n)
        parts = self.full[np.repeat(begin - ends + n, n) + np.arange(ends[-1])]
        sizes = self.end[parts] - self.begin[parts]
        got = joined(self.begin[parts], sizes, self.letters)
        of_each = np.concatenate([[0], np.cumsum(sizes)])
        to = of_each[ends]
        at = np.concatenate([[0], to[:-1]])
        fine = (got[at] != 32) & (got[to - 1] != 32)
        bad = np.flatnonzero(to_mend(got))
        fine[np.searchsorted(to, bad, "right")] = False
        start, _ = self.keep(got.tobytes())
        return at + start, to - at, fine

    def mended(self, first: int, last: int) -> tuple[int, int]:
        pieces = [[]]
        for k in range(first, last):
            if k > first and self.is_break[k]:
                pieces.append([])
            if self.has[k]:
                pieces[-1].append(self.data[self.begin[k] : self.end[k]])
        key = tuple(map(tuple, pieces))
        got = self.known.get(key)
        if got is None:
            words = (" ".join("".join([unescape(c.decode()) for c in p]).split()) for p in pieces)
            got = self.known[key] = self.keep(" ".join(filter(None, words)).encode())
        return got


class _Tags(dict):
    """Numbers of tags as they are written; each is read when it is first asked for."""

    def __init__(self):
        self.codes, self.attr, self.attrs = [], [], []

    def __missing__(self, source: bytes) -> int:
        code, attr = _tag(source, self.attrs)
        self.codes.append(code)
        self.attr.append(attr)
        self[source] = n = len(self.codes) - 1
        return n


def _plain(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[Tables, np.ndarray]:
    """Tables of the plain pages among those that begin and end at these places, and which pages are not plain."""
    letters = np.frombuffer(data, np.uint8)
    padded = np.concatenate([letters, np.zeros(16, np.uint8)])
    hidden = np.zeros(len(first), bool)
    # tags: where they begin, where the next ">" is, and their pages
    at = np.flatnonzero(letters == 60)
    page = np.repeat(np.arange(len(first)), np.diff(np.append(0, np.searchsorted(at, last))))
    room, one, two = last[page] - at, padded[at + 1], padded[at + 2]
    tag = (room > 1) & (LETTER[one] | (one == 33) | (one == 63) | ((one == 47) & (room > 2) & LETTER[two]))
    at, page = at[tag], page[tag]
    ends = np.append(np.flatnonzero(letters == 62), len(letters))
    to = ends[np.cumsum(letters == 62, dtype=np.int32)[at]]
    hidden[page[to >= last[page]]] = True
    hidden[page[1:][(page[1:] == page[:-1]) & (at[1:] < to[:-1])]] = True
    own = ~hidden[page]
    at, to, page = at[own], to[own], page[own]
    # what they are
    size = to - at - 1
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[at + 1].view("<u8").ravel() & MASKS[np.minimum(size, 8)]
    k = np.minimum(np.searchsorted(WORDS, word), len(WORDS) - 1)
    known = (WORDS[k] == word) & (SIZES[k] == size)
    code, attr = np.where(known, WORD_CODES[k], NONE), np.full(len(at), -1)
    told, rest = _Tags(), np.flatnonzero(~known)
    got = np.array([told[data[a:b]] for a, b in zip(at[rest].tolist(), (to[rest] + 1).tolist(), strict=True)], np.int64)
    code[rest], attr[rest], attrs = np.array(told.codes, np.int64)[got], np.array(told.attr, np.int64)[got], told.attrs
    hidden[page[code == HIDDEN]] = True
    raw = (code >= OPEN_RAW) & (code < END_RAW)
    follows = np.zeros(len(code), bool)
    follows[:-1] = (page[1:] == page[:-1]) & (code[1:] == code[:-1] + END_RAW - OPEN_RAW)
    hidden[page[raw & ~follows]] = True

    def opened() -> np.ndarray:
        """Whether a table is open before a tag."""
        i = np.arange(len(code))
        turn = np.maximum.accumulate(np.where((code == TABLE) | (code == END_TABLE), i, -1)) if len(i) else i
        turn = np.concatenate([[-1], turn[:-1]]).astype(np.int64)[: len(i)]
        return (turn >= groups(page)[0]) & (code[turn] == TABLE)

    inside = opened()
    hidden[page[inside & ((code == TABLE) | (code == LIST))]] = True
    own = ~hidden[page]
    at, to, page, code, attr, inside = at[own], to[own], page[own], code[own], attr[own], inside[own]
    n = len(at)
    i = np.arange(n)
    begins, stops = groups(page)

    def last_of(which: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(which, i, -1)) if n else i

    def next_of(which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The next such tag after each of k, or the end of its page's tags."""
        places = np.minimum.accumulate(np.append(np.where(which, i, n), n)[::-1])[::-1]
        return np.minimum(places[k + 1], stops[k])

    # rows begin at their tags, or at the first cell after what ends a row
    ends_row = (code == TABLE) | (inside & np.isin(code, (SECTION, END_SECTION, ROW, END_ROW, END_TABLE)))
    is_cell = inside & ((code == CELL) | (code == HEAD))
    ends_cell = ends_row | is_cell | (inside & (code == END_CELL))
    cells = np.flatnonzero(is_cell)
    row_of = last_of(ends_row)
    is_row = inside & (code == ROW)
    is_row[row_of[cells]] = True
    rows, tables = np.flatnonzero(is_row), np.flatnonzero(code == TABLE)
    # pieces of cells: from a cell's tag or a break inside it up to the next one
    held = last_of(ends_cell)
    held = (held >= begins) & is_cell[held] if n else is_cell
    is_break = (code == PARAGRAPH) | (code == END_PARAGRAPH) | (code == BREAK)
    is_piece = is_cell | (held & is_break)
    pieces = np.flatnonzero(is_piece)
    until = next_of(is_piece | ends_cell, pieces)
    by = np.where((until < stops[pieces]) & np.append(held & is_break, False)[until], np.append(code, NONE)[until], NONE)
    close = last[page]
    close[:-1] = np.where(page[1:] == page[:-1], at[1:], close[:-1])
    text = _Texts(data, letters, to + 1, close, (code < OPEN_RAW) | (code >= END_RAW), is_break)
    piece_at, piece_size = text.of(pieces, until)
    cell_of = np.cumsum(is_cell) - 1
    # a paragraph is a piece even if it is empty, unless text came since it began
    p = np.arange(len(pieces))
    ends_paragraph = (by == PARAGRAPH) | (by == END_PARAGRAPH) | (by == NONE)
    before = lambda which: np.concatenate([[-1], np.maximum.accumulate(np.where(which, p, -1))])[: len(p)] if len(p) else p
    started, passed = before(by == PARAGRAPH), before((piece_size > 0) | ends_paragraph)
    empty = (started >= groups(cell_of[pieces])[0]) & (passed == started)
    kept = (piece_size > 0) | (ends_paragraph & empty)
    # links of cells, up to what ends a link
    has_href = np.array(["href" in x for x in attrs] + [False])
    links = np.flatnonzero((code == LINK) & held & has_href[attr])
    link_at, link_size = text.of(links, next_of(np.isin(code, (LINK, END_LINK, TABLE)) | (inside & np.isin(code, (SECTION, ROW, CELL, HEAD, END_TABLE))), links))
    letters = np.concatenate([letters, np.frombuffer(b"".join(text.kept), np.uint8)])
    table_of = np.cumsum(code == TABLE) - 1
    made = Tables(
        letters, attrs, page[tables], np.arange(len(tables)) - groups(page[tables])[0], table_of[rows], (np.cumsum(is_row) - 1)[row_of[cells]], code[cells] == HEAD, attr[cells],
        cell_of[pieces][kept], piece_at[kept], piece_size[kept], cell_of[links], attr[links], link_at, link_size,
    )
    return made, hidden


def _walked(html: list[str], pages: list[int]) -> Tables:
    """The same from read_page."""
    attrs, kept, size = [], [], 0
    tables, rows, cells, pieces, links = [], [], [], [], []

    def keep(text: str) -> tuple[int, int]:
        nonlocal size
        got = text.encode()
        kept.append(got)
        size += len(got)
        return size - len(got), len(got)

    for page, source in zip(pages, html, strict=True):
        for t in read_page(source)["tables"]:
            for r in t["rows"]:
                for c in r["cells"]:
                    attrs.append(dict(c["data"]))
                    cells.append((len(rows), c["head"], len(attrs) - 1))
                    pieces += [(len(cells) - 1, *keep(p)) for p in c["parts"]]
                    for a in c["links"]:
                        attrs.append({"href": a["href"]})
                        links.append((len(cells) - 1, len(attrs) - 1, *keep(a["text"])))
                rows.append(len(tables))
            tables.append((page, t["table"]))
    columns = lambda x, n: np.array(x, np.int64).reshape(-1, n).T
    (cell_row, head, cell_attr), (table_page, table_no) = columns(cells, 3), columns(tables, 2)
    return Tables(np.frombuffer(b"".join(kept), np.uint8), attrs, table_page, table_no, np.array(rows, np.int64), cell_row, head > 0, cell_attr, *columns(pieces, 3), *columns(links, 4))


def read_tables(html: pa.Array) -> Iterator[Tables]:
    """Tables of pages, which are numbered by their place in html: those of the plain ones, and those of the others if there are any."""
    html = pc.fill_null(html.cast(pa.large_string()), "")
    ends = np.frombuffer(html.buffers()[1], np.int64)[html.offset : html.offset + len(html) + 1] if len(html) else np.zeros(1, np.int64)
    data = html.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    ends = ends - ends[0]
    made, hidden = _plain(data, ends[:-1], ends[1:])
    yield made
    if hidden.any():
        others = np.flatnonzero(hidden).tolist()
        yield _walked([data[ends[i] : ends[i + 1]].decode() for i in others], others)
