"""Edit-aware counts against counting the edited text anew."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bracketry.llm import bpe
from bracketry.llm import tokencount as C
from bracketry.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def count(text: str) -> int:
    return sum(len(x) // 4 for x in bpe.load(PATH).encode_pieces(C.whole_pieces(text))) if text else 0


def sizes(pieces):
    return [len(x) // 4 for x in bpe.load(PATH).encode_pieces(pieces)]


def plain(text: str) -> int:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(40))
def test_random_edits(seed):
    r = random.Random(seed)
    letters = "ab  .,é\n1' "
    text = "".join(r.choice(letters) for _ in range(r.randrange(0, 120)))
    pieces = C.whole_pieces(text)
    tree = C.Tree(pieces, sizes(pieces))
    for _ in range(12):
        a, b = sorted(r.randrange(0, len(text) + 5) for _ in range(2))
        new = "".join(r.choice(letters) for _ in range(r.choice([0, 0, 1, 3, 20])))
        a, b = min(a, len(text)), min(b, len(text))
        tree.edit(a, b, new, sizes)
        text = text[:a] + new + text[b:]
        assert tree.text() == text
        assert tree.n_tokens == plain(text)
        assert tree.chars[1] == len(text)


def test_edits_encode_little_of_a_long_text():
    text = "some words that go on and on " * 5000
    pieces = C.whole_pieces(text)
    tree = C.Tree(pieces, sizes(pieces))
    n = tree.edit(70_000, 70_003, "x y", sizes)
    assert n < 12 and tree.n_tokens == plain(text[:70_000] + "x y" + text[70_003:])


def test_a_tree_grows_without_encoding_what_is_old():
    tree = C.Tree.of("a b", [1, 2], [1, 1])
    text, seen = "a b", []

    def counted(pieces):
        seen.append(len(pieces))
        return sizes(pieces)

    for k in range(300):
        tree.edit(1, 1, f" w{k}", counted)
        text = text[:1] + f" w{k}" + text[1:]
    assert tree.text() == text and tree.n_tokens == plain(text) and max(seen) <= 4
    assert C.Tree.of(text, tree.stored()["chars"], tree.stored()["tokens"]).n_tokens == tree.n_tokens


def planted(d):
    return d.withColumn("tree", C.plant(F.col("text"), PATH))


def test_scrub_and_recount(spark):
    rows = [(1, "write to a.b@mail.example.org or http://x.example/y?z now"), (2, "10.0.0.1 10.0.0.2"), (3, None), (4, ""), (5, "nothing here"), (5, "nothing here"), (None, "a@b.cd"), (6, " starts with a space"), (7, "a  b <|endoftext|> 1.2.3.4")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_edits long, n_after int")
    planned = planted(d).withColumn("edits", C.scrub(F.col("text"))).withColumn("was", F.col("text"))
    got = C.apply_edits(planned, PATH).collect()
    want = {rows[0][1]: f"write to {C.MASK} or {C.MASK} now", rows[1][1]: f"{C.MASK} {C.MASK}", "a@b.cd": C.MASK, rows[-1][1]: f"a  b <|endoftext|> {C.MASK}"}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want.get(r.was, r.was)
        assert (r.n_before, r.n_after) == (plain(r.was or ""), plain(r.text or ""))
        assert (r.n_edits > 0) == (r.was in want) == (r.n_encoded > 0)
        assert sum(r.tree.chars) == len(r.text or "") and sum(r.tree.tokens) == r.n_after
        if r.was not in want:
            assert len(r.tree.chars) == len(C.whole_pieces(r.was or ""))
    assert C.apply_edits(planned.where("false"), PATH).count() == 0


def test_trees_are_kept_from_round_to_round(spark, tmp_path):
    rows = [(k, " ".join(f"word{k}x{i}" for i in range(200))) for k in range(4)]
    now, texts = planted(spark.createDataFrame(rows, "doc_id long, text string")), dict(rows)
    for n in range(3):
        now.write.parquet(f"{tmp_path}/{n}")
        edits = F.array(F.struct(F.lit(40 * n).alias("start"), F.lit(40 * n + 3).alias("stop"), F.lit(f"new {n}").alias("text"))).cast(C.EDITS)
        now = C.apply_edits(spark.read.parquet(f"{tmp_path}/{n}").withColumn("edits", F.when(F.col("doc_id") < 2, edits)), PATH)
        texts = {d: t[: 40 * n] + f"new {n}" + t[40 * n + 3 :] if d < 2 else t for d, t in texts.items()}
        for r in now.collect():
            assert (r.text, r.n_after) == (texts[r.doc_id], plain(texts[r.doc_id]))
            assert r.n_encoded <= 6


def test_addresses_in_very_long_runs(spark):
    rows = [(1, "mail x@y" + ".a" * 50_000 + " end"), (2, "a" * 100_000), (3, "a." * 50_000 + "@"), (4, "1." * 50_000), (5, ("http://" + "x" * 50) * 2000), (6, "u@v.w " * 2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", C.scrub(F.col("text")).alias("e"))
    got = {r.doc_id: [tuple(x) for x in r.e] for r in d.collect()}
    assert got[1] == [(5, 5 + len("x@y") + 100_000, C.MASK)]
    assert not got[2] and not got[3]
    assert got[5] == [(0, len(rows[4][1]), C.MASK)]
    assert got[6] == [(6 * k, 6 * k + 5, C.MASK) for k in reversed(range(2000))]


def test_edits_from_a_table(spark):
    edits = spark.createDataFrame([(1, 2, 0, 1, "Z"), (1, 1, 3, 99, None), (2, 1, 5, 2, "!")], "doc_id long, seq int, start int, stop int, text string")
    d = planted(spark.createDataFrame([(1, "abc def"), (2, "hello"), (3, "same")], "doc_id long, text string")).join(C.gather_edits(edits), "doc_id", "left")
    got = dict(C.apply_edits(d, PATH).select("doc_id", "text").collect())
    assert got == {1: "Zbc", 2: "hello!", 3: "same"}


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op6_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    import re

    own = re.compile(C.PERSONAL)
    for r in rows:
        edited = own.sub(C.MASK, texts[r.doc_id] or "")
        assert (r.n_tokens, r.n_tokens_edited) == (plain(texts[r.doc_id] or ""), plain(edited))
        assert r.n_pieces == len(C.whole_pieces(texts[r.doc_id] or ""))
