"""Token ids on disk: independent zstandard frames with a trailing seek table.

A file holds one frame for each document, in ascending document order, then a skippable frame with the document index, then
the seek table of zstandard's seekable format: compressed size, decompressed size and the low half of the XXH64 of each
frame's content. A reader takes the tail of the file, finds the frames of the documents it wants, reads and decompresses
those alone and checks them. Ids take two bytes where the vocabulary allows it, else four.

Files are written by tasks through pyarrow's file systems, so that any folder that Spark's shared settings name will do; each
attempt writes under a name of its own and renames at its end, so that a repeated or lost attempt does no harm.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import UNEVEN_RE2, cut_at_spaces, gathered, slices, strings
from .common import materialize

#: zstandard's skippable frames and its seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Entries that the memo of encoded pieces may hold.
MEMO = 1_100_000
LEVEL = 3


class LibraryEncoder:
    """The tokenizers library behind a bounded memo of pieces between safe cuts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.pieces: dict[str, bytes] = {}
        marks = list(".,;:!?")
        self.marks = dict(zip(marks, self._library(marks), strict=True))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, unknown: list[str]) -> None:
        # a word and one closing mark are two pre-tokens; the word may be known, and is from now on
        known, marks = self.pieces, self.marks
        marked = [p for p in unknown if p[-1:] in marks and p[:-1].isalpha()]
        taken = set(marked)
        new = list({*(p for p in unknown if p not in taken), *(h for p in marked if (h := p[:-1]) not in known)})
        known.update(zip(new, self._library([" " + p for p in new]), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + marks[p[-1]]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of texts; a text with a special token's string is one piece."""
        pieces = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, UNEVEN_RE2)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not pc.any(odd).as_py():
            return pieces
        own = [[t] if any(s in t for s in self.special) else cut_at_spaces(t) for t in texts.filter(odd).to_pylist()]
        at = np.arange(len(texts))
        at[odd.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(own))
        return pa.concat_arrays([pieces, pa.array(own, pieces.type)]).take(pa.array(at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without nulls in a row, and where each text's begin and end."""
        lists = self.cut(texts)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        self._learn([w for w in words if w not in self.pieces])
        # a text's first piece has no space before it
        first = bounds[:-1]
        own = [*map(self.pieces.__getitem__, words), *self._library([words[i] for i in at[first].tolist()])]
        at[first] = len(words) + np.arange(len(first))
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(own), "<u4"), sizes, at)
        return ids, np.concatenate([[0], ends])[bounds]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def width_of(path: str) -> int:
    return 2 if library(path).size <= 1 << 16 else 4


def frames(text: Column, key: Column, path: str, end_id: int, bounds: list[int]) -> Column:
    """struct<frame, n, check, part>: a document's ids with end_id in a frame of its own, how many they are, the checksum of
    the frame's content, and the range that the key is in."""

    @F.arrow_udf("struct<frame: binary, n: int, check: long, part: int>")
    def frame(texts: pa.Array, keys: pa.Array) -> pa.Array:
        encoder, kind, width = library(path), f"<u{width_of(path)}", width_of(path)
        press, end = zstandard.ZstdCompressor(level=LEVEL).compress, np.array([end_id], kind).tobytes()
        out: list[bytes] = []
        sizes: list[int] = []
        checks: list[int] = []
        for part in slices(texts.fill_null(""), 16_000_000):
            ids, ends = encoder.encode(part)
            ids, at = ids.astype(kind).tobytes(), (ends * width).tolist()
            for a, b in itertools.pairwise(at):
                content = ids[a:b] + end
                out.append(press(content))
                sizes.append(len(content) // width)
                checks.append(xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        parts = part_of(keys, bounds)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(sizes, pa.int32()), pa.array(checks, pa.int64()), parts], ["frame", "n", "check", "part"])

    return frame(text.cast("string"), key.cast("long"))


def part_of(keys: pa.Array, lasts: list[int]) -> pa.Array:
    """The first range whose last key is not below each key; null keys are the lowest."""
    at = np.searchsorted(np.array(lasts, np.int64), keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
    return pa.array(at.astype(np.int32))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    """Rows of each part; a task may have several parts, one after the other."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        part = held[0]

        def own(part=part):
            nonlocal held
            while held is not None and held[0] == part:
                yield held[1:]
                held = next(rows, None)

        yield part, own()


def _writer(root: str, width: int):
    def write(batches):
        for part, rows in _parts(batches):
            fs, base = pafs.FileSystem.from_uri(root)
            fs.create_dir(base, recursive=True)
            mine, final = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"{base}/{part:06d}.zst"
            ids, table, total, least, most = [], [], 0, None, None
            with fs.open_output_stream(mine) as out:
                for doc, frame, n, check in rows:
                    out.write(frame)
                    ids.append(doc)
                    table.append(struct.pack("<III", len(frame), n * width, check))
                    total += n
                    if doc is not None:
                        least, most = doc if least is None else least, doc
                known = np.array([d is not None for d in ids], np.uint8)
                index = struct.pack("<BI", width, len(ids)) + known.tobytes() + np.array([d or 0 for d in ids], "<i8").tobytes()
                out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
                body = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, FOOTER_MAGIC)
                out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
            fs.move(mine, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{root}/{part:06d}.zst"], "n_docs": [len(ids)], "n_ids": [total], "first_id": pa.array([least], pa.int64()), "last_id": pa.array([most], pa.int64())})

    return write


MANIFEST = "part int, path string, n_docs long, n_ids long, first_id long, last_id long"


def write_tokens(docs: DataFrame, root: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Write the ids of every document under root in ascending id_col order, one file for each range of ids.

    The manifest (one row a file) comes back as a stored table. A null text has the end id alone; null ids come first; rows
    with equal ids stand side by side, equal ids in the order of their frames; an empty table gives no file. Other columns
    are not read.
    """
    spark = docs.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], F.lit(100 * n)).alias("c")).first()["c"] if n > 1 else []
    bounds = sorted(set(cuts or []))
    made = docs.select(F.col(id_col).cast("long").alias("doc"), frames(F.col(text_col), F.col(id_col), path, end_id, bounds).alias("f"))
    dealt = made.select("f.part", "doc", "f.frame", "f.n", "f.check").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc", "frame")
    return materialize(dealt.mapInArrow(_writer(root, width_of(path)), MANIFEST), "manifest")


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, base = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(base)
        size = self.file.size()
        tail = self.file.read_at(min(size, 9), max(0, size - 9))
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        start = size - 9 - 12 * n
        self.table = np.frombuffer(self.file.read_at(12 * n, start), "<u4").reshape(n, 3).astype(np.int64)
        self.ends = np.cumsum(self.table[:, 0])
        at = int(self.ends[-1]) if n else 0
        index = self.file.read_at(start - 8 - at, at)[8:]
        self.width = index[0]
        known = np.frombuffer(index, np.uint8, n, 5).astype(bool)
        ids = np.frombuffer(index, "<i8", n, 5 + n)
        self.ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.sizes = self.table[:, 1] // self.width
        self.press = zstandard.ZstdDecompressor()

    def document(self, k: int) -> bytes:
        """Ids of the k-th document as unsigned 32-bit integers, little-endian."""
        packed, size, check = map(int, self.table[k])
        content = self.press.decompress(self.file.read_at(packed, int(self.ends[k]) - packed))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, f"<u{self.width}").astype("<u4").tobytes()


def _reader(chosen: bool):
    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                file, start, wanted = TokenFile(row["path"]), row["start"], set(row["wanted"]) if chosen else ()
                starts = start + np.concatenate([[0], np.cumsum(file.sizes)[:-1]]) if len(file.sizes) else []
                out, size = [], 0
                for k, doc in enumerate(file.ids):
                    if not chosen or (row["nulls"] if doc is None else doc in wanted):
                        out.append((doc, int(starts[k]), int(file.sizes[k]), file.document(k)))
                        size += len(out[-1][3])
                        if size > 16_000_000:
                            yield _rows(out)
                            out, size = [], 0
                if out:
                    yield _rows(out)

    return read


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def with_starts(manifest: DataFrame) -> DataFrame:
    """The number of ids in all files before each one. One row a file: a window over so few rows is no bottleneck."""
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files in a manifest: doc_id, start, n_tokens, ids (binary)."""
    n = max(1, manifest.agg(F.max("part")).first()[0] or 0) + 1
    files = with_starts(manifest).select("part", "path", "start").repartitionById(n, F.col("part"))
    return files.mapInArrow(_reader(False), ROWS)


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose ids stand in wanted, a null one for those without an id.

    Files without one are not opened, frames of others not decompressed. The last id of each file, one number a file, tells
    which file an id is in, so that ids and files meet on an equal part.
    """
    lasts = manifest.orderBy("part").select("part", F.coalesce("last_id", F.lit(-(2**63))).alias("last")).collect()
    parts, bounds = pa.array([r["part"] for r in lasts], pa.int32()), [r["last"] for r in lasts]

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        at = part_of(keys, bounds)
        return pc.if_else(pc.less(at, len(parts)), parts.take(pc.min_element_wise(at, max(0, len(parts) - 1))), None) if len(parts) else pa.nulls(len(at), pa.int32())

    near = wanted.select(F.col(id_col).cast("long").alias("w")).distinct().withColumn("part", part(F.col("w")))
    own = near.groupBy("part").agg(F.collect_list("w").alias("wanted"), F.bool_or(F.col("w").isNull()).alias("nulls"))
    return own.join(with_starts(manifest), "part").select("path", "start", "wanted", "nulls").mapInArrow(_reader(True), ROWS)
