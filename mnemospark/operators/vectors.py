"""The life of an index of session vectors: what is to be indexed, chunks and embeddings, replacement, deletion, figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import patterns as P
from mnemospark.operators import search
from mnemospark.operators.profile import embed

STORED, PREVIEW = 500, 200


def index(sessions: DataFrame, embedder: Callable[[DataFrame, str], DataFrame] = embed) -> DataFrame:
    """Vectors of sessions (session_id, text, summary): session_id, chunk_index, total_chunks, chunk_text, embedding.

    A summary stands before the first chunk for the embedding; of a chunk, the first ``STORED`` characters are kept.
    ``embedder`` adds the column embedding to rows with a text column.
    """
    pieces = search.chunks(sessions, "session_id", "text").join(sessions.select("session_id", "summary", F.length("text").alias("n")), "session_id")
    read = F.when((F.col("chunk_index") == 0) & (F.coalesce("summary", F.lit("")) != ""), F.concat("summary", F.lit("\n\n"), "chunk_text")).otherwise(F.col("chunk_text"))
    step = P.CHUNK_CHARS - P.CHUNK_OVERLAP
    total = F.when(F.col("n") <= P.CHUNK_CHARS, 1).otherwise(F.least(F.lit(P.CHUNK_MOST), F.ceil(F.col("n") / step).cast("int")))
    made = embedder(pieces.withColumn("read", read), "read")
    return made.select("session_id", "chunk_index", total.alias("total_chunks"), F.substring("chunk_text", 1, STORED).alias("chunk_text"), "embedding")


def replace(vectors: DataFrame, made: DataFrame) -> DataFrame:
    """The index with all chunks of the sessions in ``made`` replaced."""
    return vectors.join(made.select("session_id").distinct(), "session_id", "left_anti").unionByName(made)


def delete(vectors: DataFrame, sessions: DataFrame) -> DataFrame:
    return vectors.join(sessions.select("session_id"), "session_id", "left_anti")


def not_indexed(sessions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sessions that the index lacks."""
    return sessions.join(vectors.select("session_id").distinct(), "session_id", "left_anti")


def of_indexed(vectors: DataFrame, indexed: DataFrame) -> DataFrame:
    """Vectors of sessions that are on record as indexed."""
    return vectors.join(indexed.select("session_id"), "session_id", "left_semi")


def stale(sessions: DataFrame, archives: DataFrame, limit: int = 10) -> DataFrame:
    """Sessions to index: those never indexed (indexed_at null) or whose archive is newer, the latest updated first.

    ``sessions``: session_id, indexed_at, started_at; ``archives``: session_id, updated_at.
    """
    both = sessions.join(archives.select("session_id", "updated_at"), "session_id", "left")
    due = both.where(F.col("indexed_at").isNull() | (F.col("updated_at") > F.col("indexed_at")))
    return due.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("started_at"), "session_id").limit(limit)


def mark_indexed(sessions: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """Sessions with the time of indexing set for those in ``done``; an empty ``as_of`` resets them, for a full reindex."""
    marks = done.select("session_id", F.lit(True).alias("_done")).distinct()
    return sessions.join(marks, "session_id", "left").withColumn("indexed_at", F.when(F.col("_done"), as_of).otherwise(F.col("indexed_at"))).drop("_done")


def figures(sessions: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: sessions, indexed sessions, vectors, pending sessions."""
    indexed = vectors.agg(F.count_distinct("session_id").alias("indexed"), F.count("*").alias("vectors"))
    return sessions.agg(F.count("*").alias("sessions")).crossJoin(indexed).withColumn("pending", F.greatest(F.lit(0), F.col("sessions") - F.col("indexed")))  # one row each


def found(vectors: DataFrame, query: Column, limit: int = 10, project: str | None = None, chunk_types: list[str] | None = None, recency_cap: int | None = None) -> DataFrame:
    """Sessions nearest to a query vector, of a project and of some kinds of chunks, with a preview of their best chunk."""
    scope = F.lit(True)
    if project is not None:
        scope = scope & (F.col("project_path") == project)
    if chunk_types:
        scope = scope & F.col("chunk_type").isin(chunk_types)
    top = search.vector_top(vectors, query, "session_id", "chunk_index", "embedding", limit, recency_cap, scope)
    texts = vectors.select("session_id", F.col("chunk_index").alias("chunk"), F.substring("chunk_text", 1, PREVIEW).alias("preview"))
    return top.join(texts, ["session_id", "chunk"], "left").orderBy(F.desc("score"), "session_id")
