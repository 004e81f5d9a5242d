"""BPE against the tokenizers library, which applies the same vocabulary."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bracketry.llm import bpe
from bracketry.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "Hello, world!", "don't we'll I'VE it's", "  two  spaces  ", "tab\tand\nline\r\nend", "x" * 700, "ab" * 900 + " " + "é" * 400,
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "日本語のテキスト", "emoji 🙂🙃 mixed", "12345 6789 ½ ²", " nbsp  em", "aaaaaaaaaaaaaaaa aaaa", "é combining", "\x00\x01 control",
]


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(texts: list[str]) -> list[list[int]]:
    ids, bounds = bpe.load(PATH).encode_array(pa.array(texts, pa.string()))
    out = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert out == [np.frombuffer(b, "<u4").tolist() for b in bpe.load(PATH).encode_batch(texts)]
    return out


def test_texts_of_all_kinds():
    assert own_ids(TEXTS) == [library_ids(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert own_ids([text]) == [library_ids(text)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeth ' .\n<|>1é", max_size=400))
def test_text_of_few_letters(text):
    assert own_ids([text]) == [library_ids(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_any_ids_decode_as_in_the_library(ids):
    packed, want = np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.load(PATH).decode(packed) == want
    cut = np.array([ids[:1]], "<u4").tobytes()
    assert bpe.load(PATH).decode_array(pa.array([b"", cut, packed, packed[len(cut) :]], pa.binary()).slice(1)).to_pylist()[::2] == [bpe.load(PATH).decode(cut), bpe.load(PATH).decode(packed[len(cut) :])]


def test_long_words_and_rows_agree():
    own = bpe.load(PATH)
    words = [("th" * n + "e" * (n % 5)).encode() for n in range(1, 200)]
    assert own.encode_words(words) == [own._one(w) for w in words]


def test_ids_that_the_vocabulary_lacks_are_left_out():
    assert bpe.load(PATH).decode(np.array([39, 70_000], "<u4").tobytes()) == LIBRARY.decode([39])


def test_null_and_empty(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, text string")
    got = {r[0]: (bytes(r[1]), r[2]) for r in d.select("doc_id", bpe.encode(F.col("text"), PATH).alias("i")).select("doc_id", "i", bpe.decode(F.col("i"), PATH)).collect()}
    assert got[1] == got[2] == (b"", "")
    assert got[3][1] == "word"
    assert d.select(bpe.decode(F.lit(None).cast("binary"), PATH).alias("x")).first()["x"] is None
    assert d.where("false").select(bpe.encode(F.col("text"), PATH).alias("i")).collect() == []


@pytest.mark.parametrize("sf", [SMALL])
def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op10_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library_ids(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
