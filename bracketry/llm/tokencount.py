"""Token counts that follow edits.

A document keeps a segment tree over its pieces (runs of pre-tokens between cuts that hold whatever stands around them): the
characters and tokens of its pieces are columns, stored with the text, and every node has the characters and the tokens below
it. An edit finds the pieces that it touches by going down the tree, encodes those alone with one piece of context on either
side, and changes the sums on the paths above. The edited tree is columns again, so that the next round of edits encodes no
more than it touches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import cut_at_spaces, load, slices

EDITS = "array<struct<start: int, stop: int, text: string>>"
TREE = "struct<n_tokens: long, chars: array<int>, tokens: array<int>>"
#: Pieces that a leaf may hold, or the root of the number of leaves if that is more, before the tree grows new leaves.
FULL = 16


class Tree:
    """Sums of characters and tokens over the pieces of one text.

    A leaf holds a run of pieces with their tokens, at first one. New pieces are dealt over the leaves whose pieces they
    replace; when a leaf has too many, all pieces get leaves of their own again, and nothing is encoded for that.
    """

    def __init__(self, pieces: list[str], counts: list[int]):
        self._plant(list(zip(pieces, counts, strict=True)))

    @staticmethod
    def of(text: str, chars: list[int], tokens: list[int]) -> Tree:
        """The tree of a text from its stored columns."""
        ends = np.cumsum(chars).tolist()
        return Tree([text[b - n : b] for n, b in zip(chars, ends, strict=True)], tokens)

    def _plant(self, held: list[tuple[str, int]]) -> None:
        self.leaves = 1 << max(0, (len(held) - 1).bit_length())
        self.held = [[x] for x in held] + [[] for _ in range(self.leaves - len(held))]
        chars = np.zeros(2 * self.leaves, np.int64)
        tokens = np.zeros(2 * self.leaves, np.int64)
        chars[self.leaves : self.leaves + len(held)] = [len(p) for p, _ in held]
        tokens[self.leaves : self.leaves + len(held)] = [n for _, n in held]
        s = self.leaves
        while s > 1:
            for x in (chars, tokens):
                x[s // 2 : s] = x[s : 2 * s : 2] + x[s + 1 : 2 * s : 2]
            s //= 2
        self.chars, self.tokens = chars.tolist(), tokens.tolist()
        self.full = max(FULL, math.isqrt(self.leaves))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf and place in it of the piece that the character at stands in, and where the piece starts; the last piece at the end."""
        at, start, node = max(0, min(at, self.chars[1] - 1)), 0, 1
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf, k = node - self.leaves, 0
        own = self.held[leaf]
        while k + 1 < len(own) and at - start >= len(own[k][0]):
            start += len(own[k][0])
            k += 1
        return leaf, k, start

    def put(self, leaf: int, own: list[tuple[str, int]]) -> None:
        self.held[leaf] = own
        node = leaf + self.leaves
        chars = sum(len(p) for p, _ in own) - self.chars[node]
        tokens = sum(n for _, n in own) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node >>= 1

    def _beside(self, leaf: int, k: int, step: int) -> tuple[int, int]:
        """The piece before or after one, or the same where there is none."""
        if 0 <= k + step < len(self.held[leaf]):
            return leaf, k + step
        to = leaf + step
        while 0 <= to < self.leaves and not self.held[to]:
            to += step
        return (to, 0 if step > 0 else len(self.held[to]) - 1) if 0 <= to < self.leaves else (leaf, k)

    def edit(self, start: int, stop: int, new: str, sizes) -> int:
        """Put new in place of characters start to stop; sizes gives the tokens of each of some pieces. Returns how many were encoded."""
        size = self.chars[1]
        if not size:
            pieces = whole_pieces(new) if new else []
            self._plant(list(zip(pieces, sizes(pieces), strict=True)))
            return len(pieces)
        start = max(0, min(start, size))
        stop = max(start, min(stop, size))
        leaf, k, begin = self.find(start)
        first, at = self._beside(leaf, k, -1)
        if (first, at) != (leaf, k):
            begin -= len(self.held[first][at][0])
        last, upto = self._beside(*self.find(max(start, stop - 1))[:2], 1)
        before, after = self.held[first][:at], self.held[last][upto + 1 :]
        touched = self.held[first][at : upto + 1] if first == last else self.held[first][at:] + [x for i in range(first + 1, last) for x in self.held[i]] + self.held[last][: upto + 1]
        region = "".join(p for p, _ in touched)
        region = region[: start - begin] + new + region[stop - begin :]
        pieces = whole_pieces(region) if region else []
        own = [*before, *zip(pieces, sizes(pieces), strict=True), *after]
        each = -(-len(own) // (last - first + 1))
        for i in range(first, last + 1):
            self.put(i, own[(i - first) * each : (i - first + 1) * each])
        if each > self.full:
            self._plant(self._all())
        return len(pieces)

    def _all(self) -> list[tuple[str, int]]:
        return [x for own in self.held for x in own]

    def text(self) -> str:
        return "".join(p for p, _ in self._all())

    def stored(self) -> dict:
        """What TREE holds."""
        own = self._all()
        return {"n_tokens": self.n_tokens, "chars": [len(p) for p, _ in own], "tokens": [n for _, n in own]}


def whole_pieces(text: str) -> list[str]:
    first, *rest = cut_at_spaces(text)
    pieces = [first, *(" " + p for p in rest)]
    return pieces if first or len(pieces) == 1 else pieces[1:]


def plant(text: Column, path: str) -> Column:
    """TREE of a text: its tokens, and the characters and tokens of each piece.

    A null or empty text has one empty piece. Special tokens in a text count as ordinary characters. Texts are counted whole.
    """

    @F.arrow_udf(TREE)
    def planted(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int32())
        totals, chars, tokens = [pa.array([], pa.int64())], [pa.array([], kind)], [pa.array([], kind)]
        for part in slices(texts.fill_null("")):
            c, t, bounds = load(path).count_array(part)
            totals.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(t, dtype=np.int64)])[bounds])))
            ends = pa.array(bounds.astype(np.int32))
            chars.append(pa.ListArray.from_arrays(ends, pa.array(c)))
            tokens.append(pa.ListArray.from_arrays(ends, pa.array(t)))
        return pa.StructArray.from_arrays([pa.concat_arrays(totals), pa.concat_arrays(chars), pa.concat_arrays(tokens)], ["n_tokens", "chars", "tokens"])

    return planted(text.cast("string"))


def revise(text: Column, tree: Column, edits: Column, path: str) -> Column:
    """struct<text: string, tree: TREE, n_encoded: int> after the edits of a text; null where text, tree or edits are null.

    Edits (EDITS) are applied one after the other, each to the text that those before it left; spans that reach beyond the
    text are cut to it, a null new text counts as empty. Only the pieces around an edit are encoded.
    """

    @F.arrow_udf(f"struct<text: string, tree: {TREE}, n_encoded: int>")
    def revised(texts: pa.Array, trees: pa.Array, lists: pa.Array) -> pa.Array:
        bpe, out = load(path), []

        def sizes(pieces: list[str]) -> list[int]:
            return [len(x) // 4 for x in bpe.encode_pieces(pieces)]

        for text, tree, own in zip(texts, trees, lists, strict=True):
            if not (text.is_valid and tree.is_valid and own.is_valid):
                out.append(None)
                continue
            had = tree.as_py()
            t = Tree.of(text.as_py(), had["chars"], had["tokens"])
            encoded = sum(t.edit(e["start"], e["stop"], e["text"] or "", sizes) for e in own.as_py())
            out.append({"text": t.text(), "tree": t.stored(), "n_encoded": encoded})
        each = pa.list_(pa.int32())
        kind = pa.struct([("text", pa.string()), ("tree", pa.struct([("n_tokens", pa.int64()), ("chars", each), ("tokens", each)])), ("n_encoded", pa.int32())])
        return pa.array(out, kind)

    return revised(text.cast("string"), tree, edits.cast(EDITS))


def apply_edits(docs: DataFrame, path: str, text_col: str = "text", tree_col: str = "tree", edits_col: str = "edits") -> DataFrame:
    """docs, whose trees plant() or a former round made, after a round of edits: text_col and tree_col as the edits leave them.

    New columns, which replace such columns of docs: n_before, n_after (tokens), n_edits, n_encoded (pieces encoded anew). A
    row without edits, or with null ones, stays as it is and costs nothing; a null text counts as empty once it is edited.
    """
    busy = F.coalesce(F.size(edits_col) > 0, F.lit(False))
    given = [F.when(busy, F.coalesce(F.col(text_col), F.lit(""))), F.when(busy, F.col(tree_col)), F.when(busy, F.col(edits_col))]
    done = docs.withColumn("_done", revise(*given, path))
    new = {"n_before": F.col(f"{tree_col}.n_tokens"), "n_after": F.coalesce("_done.tree.n_tokens", f"{tree_col}.n_tokens"), "n_edits": F.when(busy, F.size(edits_col)).otherwise(0), "n_encoded": F.coalesce("_done.n_encoded", F.lit(0))}
    changed = {text_col: F.coalesce("_done.text", text_col), tree_col: F.coalesce("_done.tree", tree_col)}
    kept = [changed.get(c, F.col(c)).alias(c) for c in docs.columns if c not in new]
    return done.select(*kept, *[v.alias(k) for k, v in new.items()])


def gather_edits(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, edits) from a table of edits (id_col, seq, start, stop, text): each document's in the order of seq."""
    own = F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text")))
    return edits.groupBy(id_col).agg(F.transform(own, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))).cast(EDITS).alias("edits"))


#: What scrub() replaces: addresses of mail, of the web and of machines. Every repeat is of one set of characters or keeps what
#: it took, and an address of mail starts where no other character of one stands before it: time grows with the text alone.
PERSONAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|https?://[^\s]++|\b\d{1,3}(?:\.\d{1,3}){3}\b"
MASK = "[masked]"


def scrub(text: Column) -> Column:
    """Edits (EDITS) that put MASK in place of every address in a text, the last one first, so that none moves another."""
    whole = F.coalesce(text, F.lit(""))
    gaps = F.transform(F.split(whole, PERSONAL, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(whole, F.lit(f"({PERSONAL})"), F.lit(1)), F.char_length)
    each = F.filter(F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), lambda e: e["n"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(EDITS).alias("out"))

    def step(a, e):
        begin = a["at"] + e["gap"]
        edit = F.struct(begin.alias("start"), (begin + e["n"]).alias("stop"), F.lit(MASK).alias("text"))
        return F.struct((begin + e["n"]).alias("at"), F.concat(F.array(edit), a["out"]).alias("out"))

    return F.aggregate(each, start, step, lambda a: a["out"]).cast(EDITS)
