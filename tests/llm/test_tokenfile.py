"""Token-id files: round trips, random access, checksums, and what a plain reader of the format sees."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from bracketry.llm import tokenfile as T
from bracketry.llm.common import scratch
from bracketry.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, start long, ids string"


def expected(text: str | None, end: int = 2) -> bytes:
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def write(spark, rows, n_files=3):
    docs = spark.createDataFrame(rows, SCHEMA)
    return T.write_tokens(docs, scratch(spark, "test-tokens"), PATH, 2, n_files=n_files)


ROWS = [(5, "five words are in here", 0, "x"), (1, None, 0, "x"), (3, "", 0, None), (2, "two <|endoftext|> a", 0, "x"), (9, "long " * 20_000, 0, "x"), (7, "seven  spaces ", 0, "x"), (None, "no id", 0, "x"), (4, "é ü 日本", 0, "x")]


def test_round_trip_in_ascending_order(spark):
    got = sorted(T.read_tokens(spark, write(spark, ROWS)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    for r, (doc, text) in zip(got, sorted(((d, t) for d, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0])), strict=True):
        assert (r.doc_id, r.start, bytes(r.ids)) == (doc, at, expected(text))
        assert r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens


def test_repeated_rows_stand_side_by_side(spark):
    rows = [(1, "same", 0, ""), (1, "same", 0, ""), (1, "other", 0, ""), (0, "zero", 0, "")]
    got = sorted(T.read_tokens(spark, write(spark, rows, 4)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0, 1, 1, 1]
    assert sorted(bytes(r.ids) for r in got) == sorted(expected(t) for _, t, *_ in rows)


def test_empty_table(spark):
    manifest = write(spark, [])
    assert manifest.count() == 0
    assert T.read_tokens(spark, manifest).count() == 0


def test_random_access_opens_what_it_needs(spark):
    manifest = write(spark, ROWS, 4)
    wanted = spark.createDataFrame([(3,), (9,), (100,)], "doc_id long")
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in T.read_documents(spark, manifest, wanted).collect()}
    every = {r.doc_id: (r.start, bytes(r.ids)) for r in T.read_tokens(spark, manifest).collect()}
    assert got == {d: every[d] for d in (3, 9)}


def test_random_access_by_null_and_repeated_ids(spark):
    rows = [*ROWS, (None, "no id either", 0, "x"), (5, "five again", 0, "x"), *[(k, f"t{k}", 0, "") for k in range(20, 60)]]
    manifest = write(spark, rows, 5)
    wanted = spark.createDataFrame([(None,), (5,), (5,), (33,), (10_000,), (-4,)], "doc_id long")
    got = sorted((r.doc_id is not None, r.doc_id, r.start, bytes(r.ids)) for r in T.read_documents(spark, manifest, wanted).collect())
    every = sorted((r.doc_id is not None, r.doc_id, r.start, bytes(r.ids)) for r in T.read_tokens(spark, manifest).collect())
    assert got == [r for r in every if r[1] in (None, 5, 33)]
    assert T.read_documents(spark, write(spark, []), wanted).count() == 0


def paths(manifest):
    return [r.path.removeprefix("file://") for r in manifest.collect()]


def test_plain_readers_understand_the_files(spark):
    for path in paths(write(spark, ROWS, 2)):
        data = Path(path).read_bytes()
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        table, at = np.frombuffer(data[-9 - 12 * n : -9], "<u4").reshape(n, 3), 0
        for packed, size, check in table.tolist():
            content = zstandard.ZstdDecompressor().decompress(data[at : at + packed])  # each frame by itself
            assert len(content) == size
            assert xxhash.xxh64_intdigest(content) & 0xFFFFFFFF == check
            at += packed
        # decompressors pass over the index and the seek table
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == int(table[:, 1].sum())


def test_damage_is_noticed(spark):
    path = paths(write(spark, [(1, "some words that are stored", 0, "")], 1))[0]
    data = bytearray(Path(path).read_bytes())
    file = T.TokenFile(f"file://{path}")
    own = file.document(0)
    seek = len(data) - 9 - 12
    data[seek + 8] ^= 1  # the checksum
    Path(path).write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        T.TokenFile(f"file://{path}").document(0)
    assert own == expected("some words that are stored")
    Path(path).write_bytes(bytes(data[:-1]))
    with pytest.raises(ValueError, match="seek table"):
        T.TokenFile(f"file://{path}")


def test_library_memo_equals_the_library():
    texts = ["Word, word. word", " a  b", "a<|endoftext|> b", "x  y", "", "tab\t end ", "(a) 'b' it's", "one\ntwo three,", "non ,mark a.b."]
    assert T.LibraryEncoder(PATH).encode_batch(texts) == [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, SMALL).collect()}
    at = 0
    for doc in sorted(texts):
        ids = expected(texts[doc])
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
