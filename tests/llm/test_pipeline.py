"""The corpus pipeline: each stage against a plain version of what it should keep, and the whole on planted rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from tests.llm.test_decontaminate import shingles, similarity, words
from tests.llm.test_linededup import brute
from tests.llm.test_similar import kept

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SMALL), "test-stage")
        out.append(docs)
    return out


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert "pipeline" in __spark_entry__.queries()


def test_columns(stages):
    assert all(d.columns == COLUMNS for d in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "ids", "n_tokens", "decodes"]


def texts(df):
    return sorted(df.select("doc_id", "text").collect())


def test_lines(stages):
    before = texts(stages[0])
    gone = brute([tuple(r) for r in before], 50)
    after = dict(texts(stages[1]))
    for d, text in before:
        left = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone[d])
        if gone[d] and not left.split():
            assert d not in after
        else:
            assert after[d] == (left if gone[d] else text)
    assert stages[1].where(F.char_length("text") != F.col("n_chars")).count() == stages[0].where(F.char_length("text") != F.col("n_chars")).count()


def test_near_duplicates(stages):
    assert {d for d, _ in texts(stages[2])} == kept(texts(stages[1]))


def test_benchmark(spark, stages):
    items = [shingles(words(t)) for _, t in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {d for d, _ in texts(stages[3])}
    for d, t in texts(stages[2]):
        own = shingles(words(t))
        held = False
        for i in items:
            m = min(len(i), len(own))
            if m and len(set(i) & set(own)) >= 0.8 * len(set(i[:m])) * 0.9:
                held |= any(similarity(own[s : s + m], i) >= 0.8 for s in range(len(own) - m + 1))
        assert (d not in kept) == held


def test_tokens(stages):
    assert stages[4].where("not decodes").count() == 0
    assert stages[4].where("n_tokens * 4 <> octet_length(ids)").count() == 0
    assert stages[4].count() == stages[3].count()


def test_planted_rows(spark, tmp_path):
    item = " ".join(f"bench{k}" for k in range(40))
    clean = {k: " ".join(f"w{k}x{i}" for i in range(80)) for k in range(20)}
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(k, t) for k, t in clean.items()]
    near = clean[4].replace("w4x70 ", "w4x70b ")
    rows += [(100, clean[3]), (101, near), (102, "start " + item + " end"), (103, passage + "\nown words of one"), (104, passage + "\nwords of another one"), (105, None), (106, "")]
    rows += [(1000 + k, f"you are an utter numpty number {k} " + " ".join(f"t{k}y{i}" for i in range(30))) for k in range(60)]
    rows += [(2000 + k, " ".join(f"c{k}z{i}" for i in range(36))) for k in range(120)]
    docs = spark.createDataFrame([(d, t, None, None, len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1000 + k, None, 1) for k in range(40)] + [(2000 + k, None, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    for name, t in {"documents": docs, "labels": labels, "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string")}.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert not [d for d in got if 1000 <= d < 2000]  # toxic, labelled or not
    assert {d for d in got if d < 20} == set(range(20))
    assert 100 not in got and 101 not in got and 102 not in got
    assert got[103].text == passage + "\nown words of one" and got[104].text == "words of another one"
    assert (105 in got) != (106 in got) or 105 in got  # both are empty: the first stays
    assert {d for d in got if d >= 2000} == {d for d, _ in rows if d >= 2000}


def test_further_columns(spark, tmp_path):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(k, t, "en", None, len(t or ""), "x", 7, "y") for k, t in [(1, text("a")), (None, text("b")), (None, text("c")), (2, None), (2, ""), (3, text("a"))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, other int, _key string")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text("z"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "test-further")
        assert docs.where("other <> 7").count() == 0, name
    assert {(r.doc_id, (r.text or "")[:1]) for r in docs.collect()} == {(1, "a"), (None, "b"), (None, "c"), (2, "")}
    assert docs.columns[-2:] == ["n_tokens", "decodes"] and dict(docs.dtypes)["ids"] == "binary"


def test_an_empty_table(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
