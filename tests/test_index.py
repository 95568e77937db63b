"""Inverted indexes: pruned reads, updates of some documents, bounds, substrings."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import index as ix
from mnemospark.operators import search
from mnemospark.sources.store import Store, touched


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i % (n // 2), " ".join(rng.choice(["red", "Blue", "green", "the", "the", "a", "of", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(n)] + [(None, "red"), (3, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(120), "id long, text string").persist()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    out = ix.KeywordIndex(Store(spark, str(tmp_path_factory.mktemp("store"))), shards=3, parts=8)
    out.build(docs, "id", "text")
    return out


def told(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


@pytest.mark.parametrize(("terms", "every"), [(["red", "w3"], False), (["red", "blue", "w3"], True), (["the"], False), (["nowhere", "red"], False), (["nowhere", "red"], True), (["nowhere"], False)])
def test_search_as_without_index(index, docs, terms, every):
    known = docs.where("id is not null")
    for limit in (1, 7, 1000):
        want = search.bm25(known, "id", F.col("text"), terms, every).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
        assert told(index.search(terms, limit, every)) == told(want)


def test_search_reads_only_the_parts_of_its_terms(index, spark):
    blocks = index.postings(index.store.snapshot(), ["red", "w3"])
    parts = {spark.range(1).select(index._part(F.lit(t))).first()[0] for t in ("red", "w3")}
    scan = blocks._jdf.queryExecution().executedPlan().toString()
    assert all(str(p) in scan.split("PartitionFilters: [")[1].split("]")[0] for p in parts)
    read = blocks.select(F.input_file_name().alias("f"), "term").collect()
    assert {r.term for r in read} == {"red", "w3"} and {int(r.f.split("/part=")[1].split("/")[0]) for r in read} == parts


def test_update_rewrites_only_the_shards_of_its_documents(spark, docs, tmp_path):
    index = ix.KeywordIndex(Store(spark, str(tmp_path / "s")), shards=8, parts=4)
    index.build(docs, "id", "text")
    changed = spark.createDataFrame([(5,), (500,), (7,)], "id long")
    now = docs.where("id is null or id <> 7").withColumn("text", F.when(F.col("id") == 5, "blue blue").otherwise(F.col("text"))).union(spark.createDataFrame([(500, "blue w3")], "id long, text string"))
    index.update(now, "id", "text", changed)
    some = touched(changed, ["id"], 8)
    for table in ("keywords_postings", "keywords_documents", "keywords_figures"):
        old, new = (index.store.snapshot(v).tables[table].files for v in (1, 2))
        assert {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)} <= some
    want = search.bm25(now.where("id is not null"), "id", F.col("text"), ["blue", "w3"]).orderBy(F.desc(F.round("score", 9)), "id").limit(20)
    assert told(index.search(["blue", "w3"], 20)) == told(want)
    assert told(index.search(["blue", "w3"], 20, version=1)) == told(search.bm25(docs.where("id is not null"), "id", F.col("text"), ["blue", "w3"]).orderBy(F.desc(F.round("score", 9)), "id").limit(20))


def test_bounds_leave_windows_unread():
    """With a rare strong document, most windows cannot reach the best, and the result is that of all of them."""
    rng = np.random.default_rng(3)
    rows = []
    for window in range(40):
        for term in ("x", "y"):
            at = np.flatnonzero(rng.random(ix.WINDOW) < 0.02)
            tf, dl = rng.integers(1, 3, len(at)), rng.integers(50, 200, len(at))
            if window == 17:
                at[:2], tf[:2], dl[:2] = (0, 1), 9, 10
            rows.append((0, 0, term, window, len(at), tf.max(), dl.min(), ix.packed(np.diff(at, prepend=0)), ix.packed(tf), ix.packed(dl)))
    blocks = pd.DataFrame(rows, columns=[x.split()[0] for x in ix.BLOCKS.split(", ")])
    idf = {"x": 2.0, "y": 1.5}
    few, decoded = ix.best_of_shard(blocks, idf, 120.0, 2, False)
    every, whole = ix.best_of_shard(blocks, idf, 120.0, 10**9, False)
    assert decoded < 40 == whole
    assert few["no"].tolist() == every["no"].head(2).tolist()


def test_packing():
    for values in ([], [0], [255, 1], [256], [70_000, 3], [2**40]):
        assert ix.unpacked(ix.packed(np.array(values, np.int64))).tolist() == values


@pytest.mark.parametrize("query", ["the R", "é%_x", "zz", "q", "nowhere", "w1 w", "\n"])
def test_substrings(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(ix.SubstringIndex, "PIECE", 7)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["the ", "Red ", "w1 ", "É%_X", "zz", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = ix.SubstringIndex(Store(spark, str(tmp_path / "s")), shards=2, parts=4)
    index.build(docs, "id", "text")
    got = [(r.id, r.excerpts) for r in index.matches(docs, "id", "text", query).orderBy("id").collect()]
    assert got == [(r.id, r.excerpts) for r in search.substring_matches(docs, "id", "text", query).orderBy("id").collect()]
    assert [i for i, _ in got] == [i for i, t in rows if t and query.lower() in t.lower()]


def test_substring_blocks_take_a_text_at_once(spark, tmp_path, monkeypatch):
    """No row of a shuffle is a posting: what is written has a row a string and window, whatever the number of documents; rows of one key are one document."""
    rows = [(i // 2, f"abcd{chr(97 + i % 5)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    for held in (ix.SubstringIndex.HELD, 50):
        monkeypatch.setattr(ix.SubstringIndex, "HELD", held)
        index = ix.SubstringIndex(Store(spark, str(tmp_path / f"s{held}")), shards=2, parts=4)
        tables = index._tables(docs, "id", "text")
        assert "Generate" not in tables["postings"][0]._jdf.queryExecution().executedPlan().toString()
        index.build(docs, "id", "text")
        blocks = index.store.snapshot().read("substrings_postings")
        df = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        assert df["abc"] == df["bcd"] == 200 and sum(df.values()) == 200 * 2 + 400
        assert (blocks.count() == 2 * 7) == (held > 50)
        assert index.candidates("bcdb").count() == len({i // 2 for i in range(400) if i % 5 == 1})
