"""The vector index: recall with and without a filter, the exact way, updates, awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import search
from mnemospark.operators import vector_index as vi
from mnemospark.plans.index_queries import _vectors
from mnemospark.sources.store import Store


@pytest.mark.parametrize("scoped", [False, True])
def test_recall(spark, scoped):
    """Ids divisible by 100 against all vectors, by chunk: the sessions of these are few, so each vector is one."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.select(F.col("vec_id").alias("session_id"), F.col("vec_id").alias("chunk"), "embedding", (F.col("label") % 3).alias("kind"))
    scope = F.col("kind") == 1 if scoped else None
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vi.VectorIndex(Store(spark, f"{spark.conf.get('spark.checkpoint.dir')}/recall-{scoped}"), shards=4)
    index.build(rows)
    got = {(r.query_id, r.session_id) for r in index.search(asked, scope=scope).collect()}
    want = {(r.query_id, r.session_id) for r in search.vector_top_all(rows.where(scope) if scoped else rows, asked, "session_id", "chunk", "embedding").collect()}
    recall = len(got & want) / len(want)
    print("recall", scoped, recall, len(index.model().centres), index.store.snapshot().read("vectors_model").select("probes", "reranked").first())
    assert len(want) == 200 and recall >= 0.9


def test_update_and_odd_vectors(spark, tmp_path, monkeypatch):
    """Null, zero and infinite vectors match nothing; sessions are replaced; a cell in blocks gives the same."""
    rng = np.random.default_rng(1)
    made = [(i, 0, [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    rows = [*made, (90, 0, None), (91, 0, [0.0] * 6), (92, 0, [float("inf")] + [0.0] * 5), (1, 1, made[0][2]), (3, 1, made[0][2])]
    df = spark.createDataFrame(rows, "session_id long, chunk int, embedding array<double>")
    asked = spark.createDataFrame([(0, made[0][2]), (1, None), (2, [0.0] * 6)], "query_id int, query array<double>")
    index = vi.VectorIndex(Store(spark, str(tmp_path / "s")), shards=2)
    index.build(df, cells=4)
    told = lambda df: [(r.query_id, r.session_id, r.chunk, round(r.score, 9), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    plain = lambda df: told(search.vector_top_all(df.where("session_id < 90"), asked, "session_id", "chunk", "embedding", 5))
    assert told(index.search(asked, 5, exact=True)) == plain(df)
    monkeypatch.setattr(vi, "BLOCK", 7)
    assert told(index.search(asked, 5, exact=True)) == plain(df)
    now = df.where("session_id <> 1").union(spark.createDataFrame([(1, 5, [2 * x for x in made[0][2]]), (7, 1, made[0][2])], df.schema))
    index.update(now, spark.createDataFrame([(1,), (7,)], "session_id long"))
    assert told(index.search(asked, 5, exact=True)) == plain(now)
    assert [r[1] for r in told(index.search(asked, 5, exact=True))][:4] == [0, 1, 3, 7]


def test_empty_index(spark, tmp_path):
    index = vi.VectorIndex(Store(spark, str(tmp_path / "s")))
    index.build(spark.createDataFrame([], "session_id long, chunk int, embedding array<float>"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id int, query array<double>")).count() == 0


def test_registered_index_has_recall(spark, sf_dir):
    index, asked = _vectors(spark, sf_dir)
    few, every = ({(r.query_id, r.session_id, r.chunk) for r in index.search(asked, exact=e).collect()} for e in (False, True))
    assert len(few & every) >= 0.9 * len(every)


@pytest.mark.parametrize("scoped", [False, True])
def test_only_the_best_leave_a_block(spark, tmp_path, monkeypatch, scoped):
    """Exact search, blocks and groups of a few rows, with copies in and across sessions: no join brings the vectors to pairs of queries and rows."""
    rng = np.random.default_rng(3)
    made = [[float(x) for x in rng.normal(size=5)] for _ in range(60)]
    rows = [(i % 23, i, made[i * i % 60], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id long, chunk int, embedding array<float>, kind int")
    asked = spark.createDataFrame([(i, made[i]) for i in range(12)], "query_id int, query array<double>")
    index = vi.VectorIndex(Store(spark, str(tmp_path / "s")), shards=2)
    index.build(df, cells=6)
    monkeypatch.setattr(vi, "BLOCK", 11)
    monkeypatch.setattr(vi, "GROUP", 5)
    scope = F.col("kind") == 1 if scoped else None
    found = index.search(asked, 4, scope=scope, exact=True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    told = lambda df: sorted((r.query_id, r["rank"], r.session_id, r.chunk, round(r.score, 9)) for r in df.collect())
    assert told(found) == told(search.vector_top_all(df.where(scope) if scoped else df, asked, "session_id", "chunk", "embedding", 4))


def test_best_sessions():
    """At most ``limit`` rows a query, of equal cosines the first row and the first sessions."""
    v = np.array([[1.0, 0], [2, 0], [0, 1], [3, 0], [1, 1]])
    q, row, score = vi.best_sessions(np.array([[1.0, 0]]), v, vi.unit([[1.0, 0]]) @ vi.unit(v).T, None, np.array([0, 0, 1, 2, 3]), 2)
    assert (q.tolist(), row.tolist(), score.tolist()) == ([0, 0], [0, 3], [1.0, 1.0])
    q, row, _ = vi.best_sessions(np.array([[1.0, 0]]), v, vi.unit([[1.0, 0]]) @ vi.unit(v).T, np.array([[False, True, True, False, True]]), np.array([0, 0, 1, 2, 3]), 2)
    assert row.tolist() == [1, 4]


def test_decoded_vectors_give_the_scores_of_codes():
    """One product with what codes stand for is what their tables add up to, cell by cell, dimensions that parts do not divide included."""
    rng = np.random.default_rng(5)
    x = vi.unit(rng.normal(size=(300, 22)))
    q = vi.Quantiser.fit(x, 5)
    cells = q.cells(x)[:, 0]
    codes = q.encode(x, cells)
    got = q.padded(x[:9]) @ q.decoded(codes, cells).T
    for c in range(5):
        assert np.allclose(got[:, cells == c], q.scores(x[:9], codes[cells == c], c))
