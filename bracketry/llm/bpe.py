"""Byte-level BPE encoding and decoding.

A word's merges come from a segment tree over the ranks of its adjacent pairs: the root holds the lowest rank and, among
equals, the leftmost pair; a merge changes three leaves and the paths above them. Short words go through the tree
together, one tree a row of a numpy array; long ones have a tree each.

Texts are cut before every space that a non-space follows. Such a cut is always a pre-token boundary, so that the pieces
can be encoded on their own and kept in a bounded memo.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where pieces may be cut, and what rules out cutting at every space.
CUT = regex.compile(r"(?<!^)(?= \S)", regex.V1)
#: The same for Arrow's patterns, which take white space as ASCII alone.
UNEVEN_RE2 = r" (?:[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"
UNEVEN = regex.compile(r" (?:\s|$)")
#: Entries that a memo may hold, and bytes of a word up to which trees go in rows.
MEMO = 600_000
#: Marks that are a pre-token of their own after a word.
MARKS = frozenset(".,;:?!")
ROW_BYTES = 256


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if visible, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def cut_at_spaces(text: str) -> list[str]:
    """Pieces of a text; all but the first stand without the space before them."""
    if UNEVEN.search(text):
        return [p if k == 0 else p[1:] for k, p in enumerate(CUT.split(text))]
    return text.split(" ")


class Bpe:
    """One vocabulary with its memo of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_at = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pair_rank = {int(k): r for r, k in enumerate(keys)}
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int32)
        pairs_of_bytes = self._ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.byte_rank = pairs_of_bytes.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_symbol[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    # Trees

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_at[at], np.int32(len(self.merged)))

    def _rows(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of at most leaves + 1 bytes, a tree in each row; all ids in a row, and how many each word has."""
        n, width, none = len(sizes), leaves + 1, len(self.merged)
        at = np.arange(width, dtype=np.int32)
        inside = at < sizes[:, None]
        own = np.append(flat, np.zeros(width, np.uint8))[starts[:, None] + at]
        ids = self.byte_id[own]
        ids[~inside] = -1
        after = np.where(at + 1 < sizes[:, None], at + 1, np.int32(-1))
        before = np.broadcast_to(at - 1, (n, width)).copy()
        tree = np.empty((n, 2 * leaves), np.int32)
        ranks = self.byte_rank[own[:, :-1].astype(np.int32) << 8 | own[:, 1:]]
        ranks[~inside[:, 1:]] = none
        tree[:, leaves:] = ranks * leaves + at[:-1]
        s = leaves // 2
        while s:
            tree[:, s : 2 * s] = np.minimum(tree[:, 2 * s : 4 * s : 2], tree[:, 2 * s + 1 : 4 * s : 2])
            s //= 2
        row = np.arange(n)
        while True:
            root = tree[row, 1]
            row = row[root < none * leaves]
            if not len(row):
                break
            rank, pos = np.divmod(tree[row, 1], leaves)
            gone = after[row, pos]
            new, then, prev = self.merged[rank], after[row, gone], before[row, pos]
            ids[row, pos], ids[row, gone], after[row, pos] = new, -1, then
            has = then >= 0
            before[row[has], then[has]] = pos[has]
            right = np.where(has, ids[row, then], -1)
            left = np.where(prev >= 0, ids[row, prev], -1)
            rows = np.concatenate([row, row, row])
            leaf = np.concatenate([pos, np.minimum(gone, leaves - 1), np.where(prev >= 0, prev, pos)])
            rank = np.concatenate([self._ranks(new, right), np.full(len(row), none), self._ranks(left, new)])
            # a pair whose right half has gone, and the pair to the left where there is none
            keep = np.concatenate([np.ones(len(row), bool), gone < leaves, prev >= 0])
            rows, leaf, rank = rows[keep], leaf[keep], rank[keep]
            tree[rows, leaves + leaf] = rank * leaves + leaf
            node = (leaves + leaf) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
        kept = ids >= 0
        return ids[kept].astype("<u4"), kept.sum(1)

    def _one(self, word: bytes) -> bytes:
        """Encode one long word with a tree of its own."""
        none, ids = len(self.merged), self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, leaves = len(ids), 1 << (len(ids) - 1).bit_length()
        get, merged = self.pair_rank.get, self.merged.tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none * leaves + leaves] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = get(ids[i] << 32 | ids[i + 1], none) * leaves + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int) -> None:
            node = leaves + i
            tree[node] = rank * leaves + i
            while node := node >> 1:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none * leaves:
            rank, pos = divmod(tree[1], leaves)
            gone, prev = after[pos], before[pos]
            then = after[gone]
            ids[pos], ids[gone], after[pos] = merged[rank], -1, then
            put(gone, none)
            if then >= 0:
                before[then] = pos
            put(pos, get(ids[pos] << 32 | ids[then], none) if then >= 0 else none)
            if prev >= 0:
                put(prev, get(ids[prev] << 32 | ids[pos], none))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self._encode_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def encode_spaced(self, words: list[str]) -> list[bytes]:
        """The same for words that have no space in them, each with a space before it."""
        if not words:
            return []
        flat = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        starts = np.flatnonzero(flat == 0x20)
        return self._encode_flat(flat, starts, np.diff(np.append(starts, len(flat))))

    def _encode_flat(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        out: list[bytes] = [b""] * len(sizes)
        for i in np.flatnonzero(sizes > ROW_BYTES).tolist():
            out[i] = self._one(flat[starts[i] : starts[i] + sizes[i]].tobytes())
        # the least power of two that has a leaf for each pair
        levels = np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64)
        levels[(sizes == 0) | (sizes > ROW_BYTES)] = -1
        for level in np.unique(levels[levels >= 0]).tolist():
            at = np.flatnonzero(levels == level)
            block = max(1, (1 << 18) >> level)
            for k in range(0, len(at), block):
                part = at[k : k + block]
                ids, n = self._rows(flat, starts[part], sizes[part], 1 << level)
                ids, ends = ids.tobytes(), np.cumsum(n) * 4
                for i, a, b in zip(part.tolist(), (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        return out

    # Texts

    def _encode_words(self, words: set[str]) -> None:
        """Put the ids of pre-tokens in the memo."""
        listed = [w for w in words if w not in self.words]
        self.words.update(zip(listed, self.encode_words([w.encode() for w in listed]), strict=True))

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces, each with a space before it, in the memo."""
        known, plain, marked, others = self.pieces, [], [], []
        for p in pieces:
            (plain if p.isalpha() else marked if p[-1:] in MARKS and p[:-1].isalpha() else others).append(p)
        # a word and one closing mark are two pre-tokens; the word is known from now on
        plain += {b for p in marked if (b := p[:-1]) not in known}.difference(plain)
        parts = [self.pattern.findall(" " + p) for p in others]
        if len(self.words) > MEMO // 4:
            self.words.clear()
        self._encode_words({*MARKS, *itertools.chain.from_iterable(parts)})
        get = self.words.__getitem__
        mark = {m: get(m) for m in MARKS}
        known.update(zip(plain, self.encode_spaced(plain), strict=True))
        known.update((p, known[p[:-1]] + mark[p[-1]]) for p in marked)
        known.update((p, b"".join(map(get, own))) for p, own in zip(others, parts, strict=True))

    def _know(self, plain: list[list[str]]) -> list[list[str]]:
        """Learn all pieces of texts cut at spaces; gives the pre-tokens of their first pieces, which are learned as well."""
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        unknown: set[str] = set()
        for pieces in plain:
            unknown.update(pieces[1:])
        unknown = {p for p in unknown if p not in self.pieces}
        if unknown:
            self.learn(unknown)
        firsts = [self.pattern.findall(pieces[0]) for pieces in plain]
        self._encode_words(set(itertools.chain.from_iterable(firsts)))
        return firsts

    def _coded(self, texts: pa.Array, special: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: ids of unlike pieces, which piece stands where in a row, where each text's begin and end,
        and the characters of unlike pieces."""
        pieces = pc.split_pattern(texts, " ")
        whole = np.zeros(len(texts), bool)
        for token in self.special if special else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = whole | pc.match_substring_regex(texts, UNEVEN_RE2).to_numpy(zero_copy_only=False)
        if odd.any():
            own = [[""] if w else cut_at_spaces(t) for w, t in zip(whole[odd].tolist(), texts.filter(pa.array(odd)).to_pylist(), strict=True)]
            at = np.arange(len(texts))
            at[odd] = len(texts) + np.arange(len(own))
            pieces = pa.concat_arrays([pieces, pa.array(own, pieces.type)]).take(pa.array(at))
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        if unknown := {w for w in words if w not in self.pieces}:
            self.learn(unknown)
        # a text's first piece has no space before it; a text with a special token's string stands whole in its place
        first = bounds[:-1]
        parts = [self.pattern.findall(words[i]) for i in at[first].tolist()]
        self._encode_words(set(itertools.chain.from_iterable(parts)))
        starts_with = [b"".join(map(self.words.__getitem__, p)) for p in parts]
        for i in np.flatnonzero(whole).tolist():
            starts_with[i] = self.encode_batch([texts[i].as_py()])[0]
        chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        chars = np.concatenate([chars + 1, chars[at[first]]])
        at[first] = len(words) + np.arange(len(first))
        return [*map(self.pieces.__getitem__, words), *starts_with], at, bounds, chars

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without nulls: all ids in a row, and where each text's begin and end."""
        own, at, bounds, _ = self._coded(texts, True)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(own), "<u4"), sizes, at)
        return ids, np.concatenate([[0], ends])[bounds]

    def count_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pieces of texts without nulls in a row, and where each text's begin and end.

        Special tokens count as ordinary characters. A space that a text begins with stands with the piece after it.
        """
        own, at, bounds, chars = self._coded(texts, False)
        tokens = (np.fromiter(map(len, own), np.int64, len(own)) // 4)[at]
        chars = chars[at]
        keep = np.ones(len(at), bool)
        first = bounds[:-1][np.diff(bounds) > 1]
        keep[first] = chars[first] > 0
        return chars[keep].astype(np.int32), tokens[keep].astype(np.int32), np.concatenate([[0], np.cumsum(keep)])[bounds]

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Texts of binary ids without nulls."""
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].tobytes()
        got, bounds = np.frombuffer(flat, "<u4"), (offsets - offsets[0]) // 4
        if not len(got) or got.max() >= len(self.bytes_of):
            return pa.array(map(self.decode, ids.to_pylist()), pa.string())
        out, ends = gathered(self.all_bytes, self.byte_sizes, got.astype(np.int64))
        at = np.concatenate([[0], ends])[bounds]
        # bytes that are UTF-8 as a whole, with no character across two texts, are so in each text
        begins = out[at[:-1][np.diff(at) > 0]]
        try:
            if ((begins & 0xC0) == 0x80).any():
                raise UnicodeError
            str(memoryview(out), "utf-8")
        except UnicodeError:
            return pa.array(map(self.decode, ids.to_pylist()), pa.string())
        return pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, special tokens in it included, as little-endian unsigned 32-bit integers."""
        plain, plan = [], []
        for text in texts:
            parts = self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]
            plan.append([(p, -1) if p in self.special else (p, len(plain)) for p in parts if p])
            for n, (p, i) in enumerate(plan[-1]):
                if i >= 0:
                    plan[-1][n] = (p, len(plain))
                    plain.append(cut_at_spaces(p))
        firsts = self._know(plain)
        piece, word = self.pieces.__getitem__, self.words.__getitem__
        done = [b"".join([*map(word, f), *map(piece, p[1:])]) for f, p in zip(firsts, plain, strict=True)]
        return [b"".join(done[i] if i >= 0 else self.special[p].to_bytes(4, "little") for p, i in own) for own in plan]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with its own space before it if it has one."""
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        unknown = {p[1:] for p in pieces if p[:1] == " " and p[1:] not in self.pieces}
        if unknown:
            self.learn(unknown)
        parts = {p: self.pattern.findall(p) for p in pieces if p[:1] != " "}
        self._encode_words({w for ws in parts.values() for w in ws})
        return [self.pieces[p[1:]] if p[:1] == " " else b"".join(map(self.words.__getitem__, parts[p])) for p in pieces]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks nothing."""
        got = np.frombuffer(ids, "<u4")
        if len(got) and got.max() >= len(self.bytes_of):
            got = got[got < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, got.tolist())).decode("utf-8", "replace")


@functools.lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


def strings(values: pa.Array) -> list[str]:
    """Values without nulls as a list, by one join and one split unless a value has a NUL in it."""
    if not len(values):
        return []
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\0")[0].as_py().split("\0")
    return out if len(out) == len(values) else values.to_pylist()


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, of the given sizes one after the other, put together in the order of at; and where each ends."""
    starts = np.cumsum(sizes) - sizes
    take = sizes[at]
    ends = np.cumsum(take)
    return values[np.repeat(starts[at] - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def slices(values: pa.Array, limit: int = 4_000_000) -> Iterator[pa.Array]:
    """Consecutive values of about limit bytes."""
    sizes = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, side="right")))
        yield values.slice(start, stop - start)
        start = stop


def encode(text: Column, path: str) -> Column:
    """Ids of a text as binary, little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Texts are encoded whole, whatever their length. Equal texts have equal
    ids. Truncation and padding are not applied.
    """

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.binary())]
        for part in slices(texts.fill_null("")):
            flat, bounds = load(path).encode_array(part)
            out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(flat)]))
        return pa.concat_arrays(out)

    return ids(text.cast("string"))


def decode(ids: Column, path: str) -> Column:
    """Text of ids as encode() gives them; null for null."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        out = [pa.array([], pa.string()), *(load(path).decode_array(part) for part in slices(values.fill_null(b"")))]
        texts = pa.concat_arrays(out)
        return pc.if_else(values.is_null(), pa.scalar(None, pa.string()), texts) if values.null_count else texts

    return text(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
