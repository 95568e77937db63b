"""Inverted indexes over stored tables: blocks of postings, top-k search by the blocks' upper bounds, substring search.

Documents are dealt to shards by their key and numbered in the order of keys within. The postings of a term in a window of
``WINDOW`` documents of a shard are one block: delta-coded numbers, counts and lengths in as few bytes as hold them, with the
largest count and the smallest length, from which the best score a document of the block can have follows. Blocks lie in
folders of shard and part, a hash of the term: a search reads the parts of its terms, and an update of some documents
rewrites their shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.operators import search
from mnemospark.operators.staging import discard, materialise
from mnemospark.sources.store import SHARD, Snapshot, Store, Transaction, bucket, touched

WINDOW = 4096
BLOCKS = f"{SHARD} int, part int, term string, window long, n long, max_tf long, min_dl long, numbers binary, tfs binary, dls binary"


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in 1, 2, 4 or 8 bytes each, whichever hold the largest; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or values.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for shard, part, term, window, postings in batch.itertuples(index=False, name=None):
            at, tf, dl = (np.array([p[c] for p in postings], np.int64) for c in ("at", "tf", "dl"))
            rows.append((shard, part, term, window, len(at), tf.max(), dl.min(), packed(np.diff(at, prepend=0)), packed(tf), packed(dl)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])


def best_of_shard(blocks: pd.DataFrame, idf: dict[str, float], avgdl: float, limit: int, all_terms: bool) -> tuple[pd.DataFrame, int]:
    """(no, score) of the best ``limit`` documents of a shard, and the number of windows that were decoded for it.

    Windows are taken by the best score that their blocks allow, until none left can reach the ``limit``-th so far. Scores
    are compared to nine digits; at a tie, the smaller number stands first.
    """
    gain = lambda tf, dl: tf * (P.BM25_K1 + 1) / (tf + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * dl / avgdl))
    blocks = blocks.assign(bound=blocks["term"].map(idf) * gain(blocks["max_tf"], blocks["min_dl"]))
    windows = blocks.groupby("window").agg(bound=("bound", "sum"), terms=("term", "size"))
    if all_terms:
        windows = windows[windows["terms"] == len(idf)]
    groups, decoded = dict(iter(blocks.sort_values("term").groupby("window"))), 0
    best = pd.DataFrame({"no": np.empty(0, np.int64), "score": np.empty(0)})
    for window, bound in windows["bound"].sort_values(ascending=False, kind="stable").items():
        if len(best) == limit and bound < best["score"].iloc[-1] - 1e-8:
            break
        decoded += 1
        score, hits = np.zeros(WINDOW), np.zeros(WINDOW, np.int64)
        for b in groups[window].itertuples():
            at = np.cumsum(unpacked(b.numbers))
            score[at] += idf[b.term] * gain(unpacked(b.tfs), unpacked(b.dls))
            hits[at] += 1
        at = np.flatnonzero(hits == len(idf) if all_terms else hits > 0)
        best = pd.concat([best, pd.DataFrame({"no": window * WINDOW + at, "score": score[at]})])
        best = best.assign(r=-best["score"].round(9)).sort_values(["r", "no"]).drop(columns="r").head(limit)
    return best, decoded


class KeywordIndex:
    """An index of documents in a store. Rows of one key are one document; rows without a key are in none.

    ``analyse`` makes the terms of a text. ``shards`` bounds what an update rewrites and what a task of a search holds,
    ``parts`` what a search reads: about an eighth of a gigabyte for each of their pairs is a good size.
    """

    def __init__(self, store: Store, name: str = "keywords", shards: int = 16, parts: int = 32, analyse: Callable[[Column], Column] = C.tokens):
        self.store, self.name, self.shards, self.parts, self.analyse = store, name, shards, parts, analyse

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def _terms(self, docs: DataFrame, text: str) -> DataFrame:
        """key and tokens of each row."""
        return docs.select("key", self.analyse(F.col(text)).alias("tokens"))

    def _tables(self, docs: DataFrame, key: str, text: str) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
        rows = self._terms(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text), text)
        length = rows.groupBy("key").agg(F.sum(F.size("tokens")).alias("dl")).withColumn(SHARD, bucket(["key"], self.shards))
        number = F.row_number().over(Window.partitionBy(SHARD).orderBy("key")) - 1  # a shard is a bounded share
        known = materialise(length.withColumn("no", number.cast("long")).select(SHARD, "no", "key", "dl"), "index")
        counts = rows.select("key", F.explode("tokens").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
        placed = counts.join(known, "key").select(SHARD, "term", F.expr(f"no div {WINDOW}").alias("window"), (F.col("no") % WINDOW).alias("at"), "tf", "dl")
        blocks = placed.groupBy(SHARD, self._part(F.col("term")).alias("part"), "term", "window").agg(F.array_sort(F.collect_list(F.struct("at", "tf", "dl"))).alias("p"))  # at most WINDOW
        return {
            "documents": (known, ()), "figures": (known.groupBy(SHARD).agg(F.count("*").alias("n"), F.sum("dl").alias("total")), ()),
            "postings": (blocks.mapInPandas(_encode, BLOCKS), ("part",)),
        }

    def build(self, docs: DataFrame, key: str, text: str, into: Transaction | None = None) -> None:
        """Index all documents anew."""
        self._change(lambda t: [t.write(f"{self.name}_{n}", rows, [SHARD], self.shards, within) for n, (rows, within) in self._once(docs, key, text).items()], into)

    def update(self, docs: DataFrame, key: str, text: str, changed: DataFrame, into: Transaction | None = None) -> None:
        """Index the documents again whose keys are in ``changed``, new and removed ones too, from the whole table ``docs``. Only their shards are read and written."""

        def change(t: Transaction) -> None:
            some = touched(changed.select(F.col(key).alias("key")).where("key is not null"), ["key"], self.shards)
            if some:
                own = docs.where(bucket([key], self.shards).isin(sorted(some)))
                for n, (rows, _) in self._once(own, key, text).items():
                    t.replace(f"{self.name}_{n}", rows, some)

        self._change(change, into)

    def _once(self, docs: DataFrame, key: str, text: str) -> dict:
        self._made = self._tables(docs, key, text)
        return self._made

    def _change(self, change: Callable[[Transaction], object], into: Transaction | None) -> None:
        if into is not None:
            change(into)
        else:
            self.store.update(change)
        discard(self._made["documents"][0])

    def postings(self, at: Snapshot, terms: list[str]) -> DataFrame:
        """The blocks of some terms; no other parts are read."""
        rows = at.read(f"{self.name}_postings")
        parts = [self._part(F.lit(t)) for t in terms]
        return rows.where(F.col("part").isin(parts) & F.col("term").isin(terms))

    def _keys(self, at: Snapshot, found: DataFrame, shards: set[int] | None = None) -> DataFrame:
        return at.read(f"{self.name}_documents", shards).join(found, [SHARD, "no"])

    def search(self, terms: list[str], limit: int = 10, all_terms: bool = False, version: int | None = None) -> DataFrame:
        """(key, score): the best documents by BM25 that hold a term, or all of them; equal scores (to nine digits) by key."""
        at, wanted = self.store.snapshot(version), sorted({t.lower() for t in terms})
        blocks = self.postings(at, wanted)
        n, total = at.read(f"{self.name}_figures").agg(F.sum("n"), F.sum("total")).first()
        held = {r.term: r.df for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the query
        key_type = at.read(f"{self.name}_documents").schema["key"].dataType.simpleString()
        if not held or not total or all_terms and len(held) < len(wanted):
            return self.store.spark.createDataFrame([], f"key {key_type}, score double")
        idf = {t: max(P.LEAST_IDF, float(np.log((n - df + 0.5) / (df + 0.5)))) for t, df in held.items()}
        avgdl = total / n

        def best(frame: pd.DataFrame) -> pd.DataFrame:
            out, _ = best_of_shard(frame, idf, avgdl, limit, all_terms)
            return out.assign(**{SHARD: frame[SHARD].iloc[0]})[[SHARD, "no", "score"]]

        found = blocks.groupBy(SHARD).applyInPandas(best, f"{SHARD} int, no long, score double").collect()  # ``limit`` rows a shard at most
        least = sorted((round(r.score, 9) for r in found), reverse=True)[: limit][-1:]
        found = [r for r in found if least and round(r.score, 9) >= least[0]]
        top = self.store.spark.createDataFrame(found, f"{SHARD} int, no long, score double")
        return self._keys(at, top, {r[SHARD] for r in found}).select("key", "score").orderBy(F.desc(F.round("score", 9)), "key").limit(limit)


def grams(text: str, piece: int) -> np.ndarray:
    """The different three-letter strings of a text as numbers, 21 bits a letter; ``piece`` letters are looked at together."""
    out = [np.empty(0, np.int64)]
    for i in range(0, len(text) - 2, piece):
        p = np.frombuffer(text[i : i + piece + 2].encode("utf-32-le"), np.uint32).astype(np.int64)
        out.append(np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:]))
    return np.unique(np.concatenate(out)) if len(out) > 2 else out[-1]


class SubstringIndex(KeywordIndex):
    """An index of the three-letter strings of lower-cased texts. Long texts are taken in overlapping pieces.

    A task takes the texts of whole windows in the order of their documents' numbers and makes their blocks, so that texts and
    blocks are shuffled and no posting is. Beyond ``HELD`` postings, a window has more than one block of a string.
    """

    PIECE, RAREST, HELD = 1 << 20, 4, 4_000_000
    BLOCKS = f"{SHARD} int, window long, term string, n long, numbers binary"

    def __init__(self, store: Store, name: str = "substrings", shards: int = 16, parts: int = 32):
        super().__init__(store, name, shards, parts)

    def _tables(self, docs: DataFrame, key: str, text: str) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("low"))
        number = F.row_number().over(Window.partitionBy(SHARD).orderBy("key")) - 1  # a shard is a bounded share
        known = rows.select("key").distinct().withColumn(SHARD, bucket(["key"], self.shards)).withColumn("no", number.cast("long"))
        known = materialise(known.select(SHARD, "no", "key"), "index")
        placed = rows.where(F.length("low") > 2).join(known, "key").select(SHARD, F.expr(f"no div {WINDOW}").alias("window"), (F.col("no") % WINDOW).alias("at"), "low")
        placed = placed.repartition(SHARD, "window").sortWithinPartitions(SHARD, "window", "at")
        piece, most, names = self.PIECE, self.HELD, [x.split()[0] for x in self.BLOCKS.split(", ")]

        def made(shard: int, window: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            gram, at = np.concatenate([g for _, g in held]), np.repeat([a for a, _ in held], [len(g) for _, g in held])
            order = np.argsort(gram, kind="stable")  # documents stand in order
            gram, at = gram[order], at[order]
            new = np.concatenate(([True], gram[1:] != gram[:-1]))
            once = new | np.concatenate(([True], at[1:] != at[:-1]))  # rows of one document may have a string in common
            gram, at, new = gram[once], at[once], new[once]
            starts = np.flatnonzero(new)
            steps = np.where(new, at, np.diff(at, prepend=0))
            wide, ends = np.maximum.reduceat(steps, starts) > 255, np.append(starts[1:], len(gram))
            one, two = steps.astype("<u1").tobytes(), steps.astype("<u2").tobytes()  # as ``packed`` does
            numbers = [b"\2" + two[2 * i : 2 * j] if w else b"\1" + one[i:j] for i, j, w in zip(starts.tolist(), ends.tolist(), wide.tolist(), strict=True)]
            letters = np.stack([gram[starts] >> 42, gram[starts] >> 21 & 0x1FFFFF, gram[starts] & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            terms = [letters[i : i + 3] for i in range(0, len(letters), 3)]
            size = len(starts)
            columns = [pa.array(np.full(size, shard, np.int32)), pa.array(np.full(size, window, np.int64)), pa.array(terms, pa.string()), pa.array(ends - starts, pa.int64()), pa.array(numbers, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, held, size = None, [], 0
            for batch in batches:
                for shard, window, at, low in zip(*(batch.column(c).to_pylist() for c in (SHARD, "window", "at", "low")), strict=True):
                    if held and (place != (shard, window) or size >= most and held[-1][0] != at):
                        yield made(*place, held)
                        held, size = [], 0
                    place = (shard, window)
                    held.append((at, grams(low, piece)))
                    size += len(held[-1][1])
            if held:
                yield made(*place, held)

        blocks = placed.mapInArrow(run, self.BLOCKS).withColumn("part", self._part(F.col("term")))
        return {"documents": (known, ()), "postings": (blocks, ("part",))}

    def candidates(self, query: str, version: int | None = None) -> DataFrame:
        """Keys of documents that hold the rarest three-letter strings of a query of three letters or more."""
        at, low = self.store.snapshot(version), query.lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        blocks = self.postings(at, grams)
        held = sorted((r.df, r.term) for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect())  # a row a string of the query
        documents = at.read(f"{self.name}_documents").select("key")
        if len(held) < len(grams):
            return documents.limit(0)
        rarest = [t for _, t in held[: self.RAREST]]

        def common(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for window, own in frame.groupby("window"):
                terms = [np.concatenate([np.cumsum(unpacked(x)) for x in blocks]) for _, blocks in own.groupby("term")["numbers"]]
                if len(terms) == len(rarest):
                    sets = sorted(terms, key=len)
                    at = sets[0]
                    for other in sets[1:]:
                        at = at[np.isin(at, other, assume_unique=True)]
                    out.append(window * WINDOW + at)
            numbers = np.concatenate(out) if out else np.empty(0, np.int64)
            return pd.DataFrame({SHARD: np.full(len(numbers), frame[SHARD].iloc[0], np.int32), "no": numbers})

        found = self.postings(at, rarest).select(SHARD, "term", "window", "numbers").groupBy(SHARD).applyInPandas(common, f"{SHARD} int, no long")
        return self._keys(at, found).select("key")

    def matches(self, docs: DataFrame, key: str, text: str, query: str, newest: str | None = None, limit: int | None = None, version: int | None = None) -> DataFrame:
        """As ``search.substring_matches``, which checks the candidates. A query of fewer than three letters goes over all documents."""
        if len(query.lower()) > 2:
            docs = docs.join(self.candidates(query, version).withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
        return search.substring_matches(docs, key, text, query, newest, limit)
