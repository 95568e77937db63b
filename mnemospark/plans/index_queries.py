"""Registered queries: versioned tables and the indexes they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import upsert
from mnemospark.operators.index import KeywordIndex, SubstringIndex
from mnemospark.operators.staging import shared_dir
from mnemospark.operators.vector_index import VectorIndex
from mnemospark.plans.registry import EVENTS, ORACLES, query
from mnemospark.plans.search_queries import _BM25_OF, TERMS
from mnemospark.sources.store import Store
from mnemospark.sources.tables import events, table


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias("conv_id"), F.round("score", 4).alias("score"))


@query(ORACLES["search_keyword_top"])
def index_keyword_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = KeywordIndex(_store(spark), shards=4, parts=8)
    index.build(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return _named(index.search(TERMS, 25))


@query("WITH" + _BM25_OF.replace("TERMS", "'the', 'with', 'from'") + " SELECT conv_id, round(score, 4) AS score FROM s WHERE hits = 3 ORDER BY round(s.score, 9) DESC, conv_id LIMIT 40")
def index_keyword_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = KeywordIndex(_store(spark), shards=4, parts=8)
    index.build(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return _named(index.search(["the", "with", "from"], 40, all_terms=True))


@query(ORACLES["search_keyword_top"])
def index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed when some conversations were other ones, one was missing and one was too many; then these were indexed again."""
    now = table(spark, sf_dir, "conversations").select("conv_id", "text")
    odd = F.col("conv_id") % 7 == 3
    more = now.where("conv_id = 1").select((-F.col("conv_id")).alias("conv_id"), "text")
    before = now.where("conv_id <> 2").withColumn("text", F.when(odd, "with avec der").otherwise(F.col("text"))).union(more)
    index = KeywordIndex(_store(spark), shards=4, parts=8)
    index.build(before, "conv_id", "text")
    index.update(now, "conv_id", "text", now.where(odd | F.col("conv_id").isin(2)).select("conv_id").union(more.select("conv_id")))
    return _named(index.search(TERMS, 25))


@query(ORACLES["search_substring_rank"])
def index_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = SubstringIndex(_store(spark), shards=4, parts=8)
    index.build(docs, "doc_id", "text")
    found = index.matches(docs, "doc_id", "text", "of the", "n_chars", 20)
    return found.select("doc_id", "score", F.array_join("excerpts", "|").alias("excerpts"))


_BATCHES = f"WITH {EVENTS} SELECT user_id, count(*) AS n, max(event_id) AS last_event, min(ts) AS first_seen FROM e"


def _batches(spark: SparkSession, sf_dir: str) -> Store:
    """Events in three batches, merged by user one after the other, the second one twice."""
    store, e = _store(spark), events(spark, sf_dir)
    add = {"n": "sum", "last_event": "max"}

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        first = old.select("user_id", "first_seen").union(new.select("user_id", "first_seen")).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"))
        return upsert.merge(old, new, ["user_id"], add).join(first, "user_id")

    for number in (0, 1, 1, 2):
        part = e.where(F.col("event_id") % 3 == number).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.min("ts").alias("first_seen"))
        store.update(lambda t, p=part, b=number: None if t.seen("events", b) else t.merge("users", p, merged, ["user_id"], 8))
    return store


@query(f"{_BATCHES} GROUP BY user_id")
def store_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).snapshot().read("users")


@query(f"{_BATCHES} WHERE event_id % 3 <> 2 GROUP BY user_id")
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version after two batches, read when there is a later one."""
    return _batches(spark, sf_dir).snapshot(2).read("users")


@query(f"{_BATCHES} WHERE user_id % 10 = 3 GROUP BY user_id")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users by key, from their buckets alone."""
    asked = events(spark, sf_dir).where("user_id % 10 = 3").select("user_id").distinct()
    return _batches(spark, sf_dir).snapshot().lookup("users", asked)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("chunk"), "embedding", F.concat(F.lit("/p"), (F.col("label") % 2).cast("string")).alias("project_path"))
    index = VectorIndex(_store(spark), shards=4)
    index.build(rows)
    return index, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "session_id", "chunk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(ORACLES["vector_topk_all"])
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _vectors(spark, sf_dir)
    return _ranked(index.search(asked, exact=True))


@query(ORACLES["vector_topk_all"].replace("FROM embeddings, q)", "FROM embeddings, q WHERE label % 2 = 1)"))
def vector_index_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _vectors(spark, sf_dir)
    return _ranked(index.search(asked, scope=F.col("project_path") == "/p1", exact=True))


@query()
def vector_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: recall against ``vector_topk_all`` is measured in a test."""
    index, asked = _vectors(spark, sf_dir)
    return _ranked(index.search(asked))
