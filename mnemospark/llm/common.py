"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.staging import discard, materialise

#: A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


HOT_ROWS, HOT_SHARE = 1_000, 10_000


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ``null``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % parts).cast("int")


def row_key(id_col: Column, text: Column) -> Column:
    """Names a row by its id and whole text: rows are told apart even if ids repeat or are null."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def small_batches(batches: Iterator[pd.DataFrame], text_col: str, rows: int = 256, size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` characters, so that what a worker makes of them is bounded.

    Spark itself bounds the batches that come in (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB) beyond a single row.
    """
    for batch in batches:
        ends = batch[text_col].str.len().fillna(0).astype(int).cumsum().to_numpy()
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + size, "right"))))
            yield batch.iloc[at:to].reset_index(drop=True)
            at = to


def small_slices(batches: Iterator[pa.RecordBatch], text_col: str, rows: int = 1024, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same for Arrow batches, by bytes."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def join_to_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row a group, where ``size`` is a group's number of rows.

    Groups of more than ``HOT_ROWS`` rows and a ``HOT_SHARE``-th of all are fewer than ``HOT_SHARE``, so they are broadcast, and
    their rows stay where they are; the other rows are shuffled, and no key of theirs is hot.
    """
    hot = F.col(size) > max(HOT_ROWS, total // HOT_SHARE)
    large = F.broadcast(groups.where(hot))
    return rows.join(large, on).unionByName(rows.join(F.broadcast(groups.where(hot).select(on)), on, "left_anti").join(groups.where(~hot), on))


def release(spark: SparkSession) -> None:
    """Let go of plans and generated classes, for after a loop of many queries, which would fill a small driver."""
    gc.collect()  # what Python refers to stays in the JVM
    spark._jvm.System.gc()


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``links`` has long columns a and b. Returns (node, component) for every node that has a link; the component is its
    smallest node. Every round groups by node with map-side minima, so that a node with very many links is no hot task in
    the aggregation, and the join back meets one row a node, which adaptive execution can split.
    """
    spark = links.sparkSession
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "links")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if sign == seen or not sign[0]:
            break
        seen = sign
    release(spark)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """64-bit hashes of slices of a byte string, from prefix sums of a polynomial modulo 2**64, then mixed."""

    def __init__(self, room: int = 1 << 16):
        self.grow(room)

    def grow(self, room: int) -> None:
        self.up, self.down = _powers(_BASE, room + 1), _powers(_INV, room + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


#: Any key will do, as long as it stays the same.
_SIP_KEY = "9e3779b97f4a7c15"


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit keyed hash (SipHash) of each word of ``text``, in order."""
    words = text.split()
    return pd.util.hash_array(np.array(words, object), hash_key=_SIP_KEY, categorize=False) if words else np.empty(0, np.uint64)
