"""Approximate nearest neighbours in a versioned table: coarse cells, product codes, exact re-ranking.

Cells and codes are learned by k-means on a bounded sample (``SAMPLE`` vectors a cell, at most ``MOST_CELLS`` cells); then
every vector is placed. A row holds its cell, its session and chunk, further columns to filter by, the vector, and a byte for
each part of what is left of it after its cell's centre. A search scores the codes of the nearest cells only, and computes
cosines for the best of these. Cells are put together to blocks of about equal size (one with very many vectors is dealt out
to several), queries go to the blocks of their cells in groups. Vectors travel with their block, so that cosines are computed
there, and only the best sessions of a query and block leave it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators.staging import materialise
from mnemospark.sources.store import SHARD, Store

SAMPLE, MOST_CELLS, PARTS, CODES = 32, 1024, 16, 256
#: Vectors and queries that meet in one task; queries whose scores are held at a time; candidates that are re-ranked for each result, at least.
BLOCK, GROUP, SLICE, RERANKED = 20_000, 4096, 64, 20
#: Share of the nearest neighbours within the sample that cells and candidates are to hold; vectors of the sample that are asked for them.
HELD, ASKED = 0.98, 500


def unit(rows) -> np.ndarray:
    """Vectors of length 1; those without direction are not numbers."""
    x = np.array([np.asarray(r, np.float64) for r in rows])
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centres; one that loses all its points goes to the point that is farthest from its own."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        away = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        near = away.argmin(1)
        far = np.argsort(-away[np.arange(len(x)), near])
        for c in range(len(centres)):
            own = x[near == c]
            centres[c] = own.mean(0) if len(own) else x[far[c % len(far)]]
    return centres


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, added up in the order of dimensions, so that equal vectors have equal ones."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def best_sessions(x: np.ndarray, v: np.ndarray, near: np.ndarray, kept: np.ndarray | None, session: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine to 12 digits) of the best row of each of the best ``limit`` sessions of every query.

    ``near`` holds the cosines as matrix products give them, ``kept`` which rows count for which query (all, if None). Rows stand
    in the order of session (given as numbers) and chunk; of equal ones the first counts. All that may be among the best by
    ``near`` is computed anew.
    """
    if kept is not None:
        near = np.where(kept, near, -np.inf)
    starts = np.flatnonzero(np.concatenate(([True], session[1:] != session[:-1])))
    top = np.maximum.reduceat(near, starts, axis=1)
    k = min(limit, top.shape[1])
    least = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]
    top = np.where(top >= least[:, None] - 1e-9, top, np.inf)
    number = np.cumsum(np.isin(np.arange(len(session)), starts)) - 1
    q, row = np.nonzero((near >= top[:, number] - 1e-9) & np.isfinite(near))
    score = np.round(dots(v[row], x[q]) / (np.sqrt(dots(v, v))[row] * np.sqrt(dots(x, x))[q]), 12)
    order = np.lexsort((row, -score, number[row], q))
    q, row, score = q[order], row[order], score[order]
    first = np.concatenate(([True], (q[1:] != q[:-1]) | (number[row[1:]] != number[row[:-1]])))[: len(q)]
    q, row, score = q[first], row[first], score[first]
    order = np.lexsort((row, -score, q))
    q, row, score = q[order], row[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < limit], row[place < limit], score[place < limit]


class Quantiser:
    """Centres of cells, and for each part of the dimensions the centres of its codes."""

    def __init__(self, centres: np.ndarray, codes: np.ndarray):
        self.centres, self.codes = centres, codes  # codes: part, code, dimension of the part

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, parts: int = PARTS, seed: int = 1) -> Quantiser:
        rng = np.random.default_rng(seed)
        parts = min(parts, x.shape[1])
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
        centres = kmeans(x, cells, rng)
        rest = (x - centres[cls._nearest(x, centres, 1)[:, 0]]).reshape(len(x), parts, -1).swapaxes(0, 1)
        codes = [kmeans(r, CODES, rng, 6) for r in rest]
        return cls(centres, np.stack(codes))

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        away = (centres * centres).sum(1) - 2 * x @ centres.T
        return away.argmin(1)[:, None] if n == 1 else np.argsort(away, axis=1, kind="stable")[:, :n]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - x.shape[1])))

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return self._nearest(self.padded(x), self.centres, n)

    def encode(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = (self.padded(x) - self.centres[cells]).reshape(len(x), len(self.codes), -1)
        return np.stack([self._nearest(rest[:, p], c, 1)[:, 0] for p, c in enumerate(self.codes)], 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """[query, vector]: estimated cosines of the vectors with these codes in a cell."""
        q = self.padded(queries)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), 1)
        for p, part in enumerate(q.reshape(len(q), len(self.codes), -1).swapaxes(0, 1)):
            out += (part @ self.codes[p].T)[:, codes[:, p]]
        return out

    def decoded(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for; products with them are the estimated cosines, of all cells at once."""
        rest = np.stack([part[codes[:, p]] for p, part in enumerate(self.codes)], 1).reshape(len(codes), -1)
        return self.centres[cells] + rest

    def calibrated(self, x: np.ndarray, limit: int = 10) -> tuple[int, int]:
        """How many cells, and candidates for each result, hold the share ``HELD`` of the nearest neighbours within a sample.

        Neighbours within all vectors are nearer than those within a sample, so that this is on the safe side.
        """
        n = min(limit + 1, len(x))
        home = self.cells(x)[:, 0]
        cell_places, vector_places = [], []
        codes, asked = self.encode(x, home), min(ASKED, len(x))
        guesses = np.empty((asked, len(x)))
        for c in np.unique(home):
            guesses[:, home == c] = self.scores(x[:asked], codes[home == c], c)
        for q in range(asked):
            near = np.argsort(-(x @ x[q]), kind="stable")[:n]
            place = np.empty(len(self.centres), np.int64)
            place[self.cells(x[q : q + 1], len(self.centres))[0]] = np.arange(len(self.centres))
            cell_places.append(place[home[near]])
            order = np.empty(len(x), np.int64)
            order[np.argsort(-guesses[q], kind="stable")] = np.arange(len(x))
            vector_places.append(order[near])
        most = lambda places: int(np.quantile(np.concatenate(places), HELD, method="higher")) + 1 if places else 1
        return most(cell_places), -(-most(vector_places) // limit)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, centres=self.centres, codes=self.codes)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Quantiser:
        found = np.load(io.BytesIO(data))
        return cls(found["centres"], found["codes"])


class VectorIndex:
    """An index of vectors of chunks of sessions in a store: columns session_id, chunk, embedding, and any others to filter by.

    Vectors that are null, zero or not finite are in no result. ``shards`` is how many parts an update rewrites one or some of.
    """

    def __init__(self, store: Store, name: str = "vectors", shards: int = 16):
        self.store, self.name, self.shards = store, name, shards

    def _placed(self, vectors: DataFrame, model: Quantiser) -> DataFrame:
        shared, shards = vectors.sparkSession.sparkContext.broadcast(model.dumped()), self.shards  # at most MOST_CELLS centres
        kind = f"{vectors.schema.simpleString()[7:-1].replace(':', ' ')}, cell int, codes binary, {SHARD} int"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = Quantiser.loaded(shared.value)
            for batch in batches:
                batch = batch[batch["embedding"].notna()]
                if len(batch):
                    x = unit(batch["embedding"])
                    some = np.isfinite(x).all(1)
                    x, batch = x[some], batch[some]
                    if not len(batch):
                        continue
                    cells = q.cells(x)[:, 0]
                    yield batch.assign(cell=cells, codes=[c.tobytes() for c in q.encode(x, cells)], **{SHARD: cells % shards})

        return vectors.mapInPandas(run, kind)

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Learn from a sample by hash, then place every vector. ``cells``: by default the root of the number of vectors, 8 at least."""
        known = vectors.where("embedding is not null")
        cells = cells or int(min(MOST_CELLS, max(8, round(known.count() ** 0.5))))
        sample = known.orderBy(F.xxhash64("session_id", "chunk"), "session_id", "chunk").limit(max(SAMPLE * cells, 4 * CODES)).select("embedding").toPandas()
        x = unit(sample["embedding"]) if len(sample) else np.empty((0, 1))
        x = x[np.isfinite(x).all(1)]
        x = x if len(x) else np.ones((1, 1))
        model = Quantiser.fit(x, cells)
        probes, reranked = model.calibrated(x)
        spark = vectors.sparkSession

        def change(t) -> None:
            t.write(f"{self.name}_model", spark.createDataFrame([(0, bytearray(model.dumped()), probes, max(RERANKED, reranked))], f"{SHARD} int, model binary, probes int, reranked int"), [SHARD], 1)
            t.write(f"{self.name}_lists", self._placed(vectors, model), [SHARD], self.shards, ["cell"])

        self.store.update(change)

    def model(self, version: int | None = None) -> Quantiser:
        return Quantiser.loaded(bytes(self.store.snapshot(version).read(f"{self.name}_model").first()["model"]))

    def update(self, vectors: DataFrame, changed: DataFrame) -> None:
        """Put the vectors of the sessions in ``changed`` in place of what the index has of them. Only shards that hold some are rewritten."""

        def change(t) -> None:
            lists, ids = t.read(f"{self.name}_lists"), changed.select("session_id").distinct()
            new = materialise(self._placed(vectors.join(ids, "session_id", "left_semi").select([c for c in lists.columns if c not in ("cell", "codes", SHARD)]), Quantiser.loaded(bytes(t.read(f"{self.name}_model").first()["model"]))), "placed")
            some = {r[0] for r in lists.join(ids, "session_id", "left_semi").select(SHARD).union(new.select(SHARD)).distinct().collect()}  # at most ``shards``
            if some:
                t.replace(f"{self.name}_lists", t.read(f"{self.name}_lists", some).join(ids, "session_id", "left_anti").unionByName(new), some)

        self.store.update(change)

    def search(self, queries: DataFrame, limit: int = 10, probes: int | None = None, scope: Column | None = None, reranked: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, session_id, chunk, score, rank): for queries (query_id, query), the best chunk of each session, best sessions first.

        ``probes`` cells are looked at and ``reranked`` candidates compared, by default as many as held nearly all neighbours within
        the sample. ``scope`` is a condition on the rows; as many more cells are looked at as it leaves fewer rows. ``exact`` compares
        every query with every vector, whose number of comparisons is by nature their product; what leaves a block is ``limit`` rows a query. Scores are compared to 12 digits.
        """
        found = self.store.snapshot().read(f"{self.name}_model").first()
        model, probes = Quantiser.loaded(bytes(found["model"])), probes or found["probes"]
        lists = self.store.snapshot().read(f"{self.name}_lists")
        sizes = lists.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(scope if scope is not None else F.lit(True)).alias("kept")).collect()  # a row a cell
        total, kept = sum(r.n for r in sizes), sum(r.kept for r in sizes)
        cells = len(model.centres)
        probes = cells if exact else max(1, min(cells, -(-probes * total // max(1, kept))))
        reranked = reranked or found["reranked"] * limit
        if scope is not None:
            lists = lists.where(scope)
        spark = lists.sparkSession
        shared = spark.sparkContext.broadcast(model.dumped())
        ids = {c: queries.schema[c].dataType.simpleString() for c in ("query_id",)} | {c: lists.schema[c].dataType.simpleString() for c in ("session_id", "chunk")}
        first, blocks = _blocks({r.cell: r.kept for r in sizes}, cells)  # of each cell
        every = int((first + blocks).max())
        groups = max(1, -(-queries.count() // GROUP))

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = Quantiser.loaded(shared.value)
            for batch in batches:
                batch = batch[batch["query"].notna()]
                if len(batch):
                    x = unit(batch["query"])
                    some = np.isfinite(x).all(1)
                    batch, x = batch[some], x[some]
                    if not len(batch):
                        continue
                    if exact:
                        of = [np.arange(every)] * len(batch)
                    else:
                        of = [np.unique(np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in near])) for near in q.cells(x, probes)]
                    n = [len(b) for b in of]
                    yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), n), "block": np.concatenate(of), "query": [v for v, k in zip(batch["query"], n, strict=True) for _ in range(k)]})

        def scored(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own) and len(rows):
                q, rows = Quantiser.loaded(shared.value), rows.sort_values(["session_id", "chunk"]).reset_index(drop=True)
                v, session, cell = np.stack(rows["embedding"]).astype(np.float64), pd.factorize(rows["session_id"])[0], rows["cell"].to_numpy()
                codes, direction = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1), unit(rows["embedding"])
                told = None if exact else q.decoded(codes, cell)
                for at in range(0, len(own), SLICE):
                    part = own.iloc[at : at + SLICE]
                    x, asked, kept = np.stack(part["query"]).astype(np.float64), unit(part["query"]), None
                    if not exact:
                        looked = np.zeros((len(x), len(q.centres)), bool)
                        np.put_along_axis(looked, q.cells(asked, probes), True, 1)
                        kept = looked[:, cell]
                        guess = np.where(kept, q.padded(asked) @ told.T, -np.inf)
                        if reranked < len(rows):
                            kept &= guess >= -np.partition(-guess, reranked - 1, axis=1)[:, reranked - 1 : reranked]
                    of, row, score = best_sessions(x, v, asked @ direction.T, kept, session, limit)
                    out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[of], "session_id": rows["session_id"].to_numpy()[row], "chunk": rows["chunk"].to_numpy()[row], "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "session_id": [], "chunk": [], "score": []})

        of_cell = lambda x: F.get(F.array(*[F.lit(int(i)) for i in x]), F.col("cell"))
        dealt = lists.withColumn("block", of_cell(first) + F.pmod(F.xxhash64("session_id", "chunk"), of_cell(blocks)).cast("int"))
        dealt = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "cell", "session_id", "chunk", "codes", "embedding")
        asked = queries.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"))
        asked = asked.mapInPandas(probed, f"query_id {ids['query_id']}, block int, query array<double>").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        near = asked.groupBy("block", "group").cogroup(dealt.groupBy("block", "group")).applyInPandas(scored, f"query_id {ids['query_id']}, session_id {ids['session_id']}, chunk {ids['chunk']}, score double")
        best = near.groupBy("query_id", "session_id").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("b")).select("query_id", "session_id", "b.*")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "session_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def _blocks(sizes: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and how many it is dealt out to: cells in order fill blocks of up to ``BLOCK`` vectors."""
    first, blocks = np.zeros(cells, np.int64), np.ones(cells, np.int64)
    at, held = 0, 0
    for c in range(cells):
        n = sizes.get(c, 0)
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        first[c], blocks[c] = at, max(1, -(-n // BLOCK))
        at, held = (at + blocks[c], 0) if blocks[c] > 1 else (at, held + n)
    return first, blocks
