"""One pass over the tags of a page: its tables with their cells, list items and headings, whatever was left unclosed.

A row ends where the next one begins, a cell where the next one does, and a table's end closes all that is open inside it. Text
belongs to the innermost cell or item, so that nested tables are tables of their own with the number of the one around them.
Every letter is looked at a bounded number of times.
"""

from __future__ import annotations

import re
from html import unescape

TAG = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
RAW = {"script", "style", "textarea", "title"}
BREAKS = {"p", "div", "br", "li", "dd", "dt", "section", "hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The largest spans that pages may ask for. From that column on cells do not reach into the rows below.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Sink:
    """Text of a cell, an item, a heading or a link, in the pieces between breaks. A paragraph is a piece even if it is empty."""

    __slots__ = ("kind", "parts", "now", "made", "empty")

    def __init__(self, kind: str, made: dict):
        self.kind, self.made, self.parts, self.now, self.empty = kind, made, [], [], False

    def cut(self, paragraph: bool = False) -> None:
        """End a piece; paragraph: end a paragraph too, if one is open."""
        piece = " ".join("".join(self.now).split())
        if piece or (paragraph and self.empty):
            self.parts.append(piece)
            self.empty = False
        self.now = []

    def close(self) -> None:
        self.cut(True)
        self.made["text"] = " ".join(filter(None, self.parts))
        if "parts" in self.made:
            self.made["parts"] = self.parts


class _Table:
    def __init__(self, made: dict):
        self.made, self.row, self.section, self.spans, self.n = made, None, "", [], 0

    def new_row(self, classes: str) -> None:
        self.row = {"section": self.section, "class": classes, "cells": []}
        self.at, self.passed, self.below, self.n = 0, 0, [], self.n + 1
        self.made["rows"].append(self.row)

    def place(self, columns: int, rows: int) -> int:
        """The first column from here on that no cell above reaches into; the ends of spans are by their last row."""
        while self.passed < len(self.spans) and self.spans[self.passed][0] <= self.at:
            _, end, last = self.spans[self.passed]
            if last >= self.n and end > self.at:
                self.at = end
            self.passed += 1
        col, self.at = self.at, self.at + columns
        if rows > 1 and col < MOST_COLUMNS:
            self.below.append((col, col + columns, self.n + rows - 1))
        return col

    def end_row(self) -> None:
        if self.row is not None:
            if self.below:
                self.spans = sorted(x for x in [*self.spans, *self.below] if x[2] > self.n)
            self.row = None


def _number(text: str | None, most: int) -> int:
    return min(int(text), most) if text and text.isascii() and text.isdigit() and int(text[:9]) else 1


class _Page:
    def __init__(self):
        self.tables, self.items, self.headings = [], [], []
        self.stack: list = []  # _Table, _Sink of a cell or item, or "list"
        self.parents: list[_Table] = []
        self.heading = self.link = None
        self.heading_at = 0

    def text(self, chunk: str) -> None:
        for s in (self.stack[-1] if self.stack else None, self.heading, self.link):
            if isinstance(s, _Sink):
                s.now.append(chunk)

    def cut(self, tag: str, begins: bool) -> None:
        for s in (self.stack[-1] if self.stack else None, self.heading, self.link):
            if isinstance(s, _Sink):
                s.cut(tag == "p")
                s.empty = s.empty or (tag == "p" and begins)

    def pop(self) -> None:
        top = self.stack.pop()
        if isinstance(top, _Sink):
            top.close()
        elif isinstance(top, _Table):
            top.end_row()

    def back_to_table(self) -> _Table | None:
        """The innermost open table, with all inside it closed."""
        if not self.parents:
            return None
        while not isinstance(self.stack[-1], _Table):
            self.pop()
        return self.stack[-1]

    def end_link(self) -> None:
        if self.link:
            self.link.close()
            self.link = None

    def end_heading(self) -> None:
        if self.heading:
            self.heading.close()
            self.heading = None

    def start(self, tag: str, a: dict[str, str]) -> None:
        if tag in BREAKS:
            self.cut(tag, True)
        if tag == "table":
            self.end_link()
            parent = self.parents[-1].made["table"] if self.parents else -1
            made = {"table": len(self.tables), "parent": parent, "id": a.get("id", ""), "class": a.get("class", ""), "rows": []}
            self.tables.append(made)
            t = _Table(made)
            self.stack.append(t)
            self.parents.append(t)
        elif tag in ("thead", "tbody", "tfoot", "tr", "td", "th"):
            t = self.back_to_table()
            if t is None:
                return
            self.end_link()
            if tag[0] == "t" and len(tag) == 5:
                t.end_row()
                t.section = tag
            elif tag == "tr":
                t.end_row()
                t.new_row(a.get("class", ""))
            else:
                if t.row is None:
                    t.new_row("")
                columns, rows = _number(a.get("colspan"), MOST_COLUMNS), _number(a.get("rowspan"), MOST_ROWS)
                cell = {"col": t.place(columns, rows), "rowspan": rows, "colspan": columns, "head": tag == "th", "class": a.get("class", ""), "data": [(k, v) for k, v in a.items() if k.startswith("data-")], "text": "", "parts": [], "links": []}
                t.row["cells"].append(cell)
                self.stack.append(_Sink("cell", cell))
        elif tag in ("ul", "ol"):
            self.stack.append("list")
        elif tag == "li":
            if self.stack and isinstance(self.stack[-1], _Sink) and self.stack[-1].kind == "item":
                self.pop()
            item = {"class": a.get("class", ""), "text": "", "links": []}
            self.items.append(item)
            self.stack.append(_Sink("item", item))
        elif tag in HEADINGS:
            self.end_heading()
            made = {"level": int(tag[1]), "class": a.get("class", ""), "text": "", "source": None}
            self.headings.append(made)
            self.heading = _Sink("heading", made)
        elif tag == "a":
            self.end_link()
            if "href" in a:
                made = {"href": " ".join(a["href"].split()), "text": ""}
                top = self.stack[-1] if self.stack else None
                if isinstance(top, _Sink):
                    top.made["links"].append(made)
                self.link = _Sink("link", made)

    def end(self, tag: str) -> None:
        if tag in BREAKS:
            self.cut(tag, False)
        if tag == "table":
            if self.back_to_table() is not None:
                self.end_link()
                self.pop()
                self.parents.pop()
        elif tag in ("thead", "tbody", "tfoot", "tr"):
            t = self.back_to_table()
            if t is not None:
                t.end_row()
                t.section = t.section if tag == "tr" else ""
        elif tag in ("td", "th"):
            self.back_to_table()
        elif tag in ("ul", "ol"):
            # an item may be open above the list, but no cell: that is another list's end
            if self.stack and isinstance(self.stack[-1], _Sink) and self.stack[-1].kind == "item" and self.stack[-2:-1] == ["list"]:
                self.pop()
            if self.stack and self.stack[-1] == "list":
                self.stack.pop()
        elif tag == "li":
            if self.stack and isinstance(self.stack[-1], _Sink) and self.stack[-1].kind == "item":
                self.pop()
        elif tag in HEADINGS:
            self.end_heading()
        elif tag == "a":
            self.end_link()


def read_attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from there on, and where it ends."""
    found, n = {}, len(html)
    while at < n and html[at] != ">":
        a = ATTRIBUTE.match(html, at)
        if a is None:
            at += 1
            continue
        at = a.end()
        value = a.group(2) or ""
        value = value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value
        found.setdefault(a.group(1).lower(), unescape(value))
    return found, at


def read_page(html: str) -> dict:
    """{tables, items, headings} of a page, in the order in which they begin; a heading's source is as written, null without its end."""
    page = _Page()
    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            page.text(unescape(html[at:]))
            break
        if m.start() > at:
            page.text(unescape(html[at : m.start()]))
        at = m.end()
        if m.group(3) is None:
            # a comment or a declaration; one without an end takes the rest
            close = "-->" if m.group(1) is None else ">"
            end = html.find(close, at)
            at = n if end < 0 else end + len(close)
            continue
        found, at = read_attributes(html, at)
        tag = m.group(3).lower()
        at += 1
        if m.group(2):
            if page.heading and tag in HEADINGS and page.heading.made["level"] == int(tag[1]):
                page.heading.made["source"] = html[page.heading_at : m.start()]
            page.end(tag)
        else:
            page.start(tag, found)
            page.heading_at = at if tag in HEADINGS else page.heading_at
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = n if end is None else end.start()
    page.end_link()
    page.end_heading()
    while page.stack:
        page.pop()
    return {"tables": page.tables, "items": page.items, "headings": page.headings}
