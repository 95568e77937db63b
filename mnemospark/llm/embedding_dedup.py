"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length 1, where a cosine of at least c is a distance of at most sqrt(2 - 2c). A hash is a Gaussian
projection, shifted and cut into cells of ``CELL``; ``depth`` of them make a bucket, and there are ``tables`` sets of
buckets. Both numbers follow from the count of vectors by one rule: random vectors meet about ``MEET`` others a table, which
a matrix product settles for less than a further copy of the vectors costs, and a pair just at the threshold is missed with
a probability of at most ``MISS``. Vectors travel in the precision they were given in. Pairs that share a bucket are checked by their
cosine in double precision, in blocks of matrix products; no pair leaves its task, only counts and a spanning star.

Equal vectors are one class, hashed once, so copies never meet. A bucket of more than ``BLOCK`` classes is dealt out as
pairs of blocks to as many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import connected_components, materialise, mix64

CELL, MISS, BLOCK, MEET = 1.2, 1e-3, 1024, 32
THRESHOLD = 0.95
FEW_BUCKETS = 10_000
#: Up to this size, the pairs of a unit are checked in a sweep over all units.
SMALL = 48


def _meet(distance: float, cell: float = CELL) -> float:
    """Probability that one hash puts two points of this distance into one cell."""
    x = cell / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(depth, tables) for so many vectors."""
    near, far = _meet(math.sqrt(max(1e-6, 2 - 2 * threshold))), _meet(math.sqrt(2))
    depth = max(2, round(math.log(max(2, vectors / MEET)) / -math.log(far)))
    return depth, math.ceil(math.log(1 / MISS) / near**depth)


def bucket_keys(unit: np.ndarray, depth: int, tables: int, seed: int = 5) -> np.ndarray:
    """[vector, table] keys of unit vectors (rows)."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    lines = rng.standard_normal((unit.shape[1], depth * tables))
    cells = np.floor((unit @ lines + rng.random(depth * tables) * CELL) / CELL).astype(np.int64).reshape(len(unit), tables, depth)
    key = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for i in range(depth):
        key = mix64(key * np.uint64(31) + cells[:, :, i].astype(np.uint64))
    return key.view(np.int64)


def _stack(vectors, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(depth: int, tables: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["v"].str.len()):
                for at in range(0, len(same), 512):
                    part = same.iloc[at : at + 512]
                    keys = bucket_keys(_scaled(_stack(part["v"], kind)), depth, tables)
                    yield pd.DataFrame({"cid": part["cid"].to_numpy(), "copies": part["copies"].to_numpy(), "v": part["v"].to_numpy(), "keys": list(keys)})

    return run


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _near(x: np.ndarray, unit: np.ndarray, side: np.ndarray, split: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit with a cosine of at least the threshold. Rows stand by unit, and in split units by side.

    In split units only pairs of different sides count. Small units meet offset by offset in one sweep over all of them,
    large ones in matrix products.
    """
    cuts = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]))
    sizes = np.diff(cuts)
    large = (sizes > SMALL) | split[cuts[:-1]]
    few = np.repeat(~large, sizes)
    left, right = [], []
    for k in range(1, SMALL):
        at = np.flatnonzero(few[:-k] & (unit[k:] == unit[:-k])) if k < len(unit) else []
        if not len(at):
            break
        for chunk in np.array_split(at, -(-len(at) // 50_000)):
            hit = chunk[np.einsum("ij,ij->i", x[chunk], x[chunk + k]) >= threshold]
            left.append(hit)
            right.append(hit + k)
    for u in np.flatnonzero(large):
        a, b = cuts[u], cuts[u + 1]
        if split[a]:
            m = a + int((side[a:b] == 0).sum())
            i, j = np.nonzero(x[a:m] @ x[m:b].T >= threshold)
            left.append(a + i)
            right.append(m + j)
        else:
            i, j = np.nonzero(np.triu(x[a:b] @ x[a:b].T, 1) >= threshold)
            left.append(a + i)
            right.append(a + j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _check(depth: int, tables: int, threshold: float, kind: str):
    def found(rows: pd.DataFrame) -> pd.DataFrame | None:
        """Counts and links of whole units of vectors of one length."""
        x = _scaled(_stack(rows["v"], kind))
        marks = rows[["t", "key", "p", "q"]].to_numpy()
        unit = np.concatenate(([0], np.cumsum((marks[1:] != marks[:-1]).any(1))))
        i, j = _near(x, unit, rows["side"].to_numpy(), marks[:, 2] != marks[:, 3], threshold)
        if not len(i):
            return None
        # a pair counts in the first table that has both in one bucket
        table = marks[i, 0]
        used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        keys = np.concatenate([bucket_keys(x[used[s : s + 512]], depth, tables) for s in range(0, len(used), 512)])
        a, b = place[: len(i)], place[len(i) :]
        first = np.concatenate([(keys[a[s : s + 20_000]] == keys[b[s : s + 20_000]]).argmax(1) for s in range(0, len(i), 20_000)])
        i, j = i[first == table], j[first == table]
        cid, copies = rows["cid"].to_numpy(), rows["copies"].to_numpy()
        nodes, place = np.unique(np.concatenate((cid[i], cid[j])), return_inverse=True)
        links = np.bincount(place, np.concatenate((copies[j], copies[i])), len(nodes)).astype(np.int64)
        parent = {n: n for n in nodes.tolist()}
        for p, q in zip(cid[i].tolist(), cid[j].tolist(), strict=True):
            p, q = _find(parent, p), _find(parent, q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        return pd.DataFrame({"cid": nodes, "links": links, "root": [_find(parent, n) for n in nodes.tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["dim", "t", "key", "p", "q"]
        held: pd.DataFrame | None = None

        def closed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, same in rows.groupby("dim", sort=False):
                if (out := found(same)) is not None:
                    yield out

        for batch in batches:
            rows = batch if held is None or not len(held) else pd.concat((held, batch))
            if not len(rows):
                continue
            marks = rows[names].to_numpy()
            last = int(np.argmax((marks == marks[-1]).all(1)))  # the last unit may go on
            if last:
                yield from closed(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield from closed(held)

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of
    different length. n_links counts other rows, equal vectors among them. component_id is the smallest known id that is
    reachable (null if none is known), kept says whether the row has it; of repeated rows with that id, each is kept. An
    empty table gives no rows.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = F.col("v")
    sound = F.coalesce(v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).withColumn("sound", sound)
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("sound").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("rid").alias("cid"))
    classes = materialise(classes, "classes")
    depth, tables = plan(classes.count(), threshold)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cid": batch["cid"], "copies": batch["copies"], "v": [np.asarray(x, kind).tobytes() for x in batch["v"]]})

    packed = classes.select("cid", "copies", "v").mapInPandas(pack, "cid long, copies long, v binary")
    hashed = materialise(packed.mapInPandas(_hash(depth, tables, kind), "cid long, copies long, v binary, keys array<long>"), "hashed")
    spread = hashed.select("cid", "copies", "v", F.octet_length("v").alias("dim"), F.posexplode("keys").alias("t", "key"))
    large = hashed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = materialise(large.select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    if large.count() <= FEW_BUCKETS:
        large = F.broadcast(large)
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = spread.join(large, ["t", "key"]).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cid", "copies", "v", "dim", "t", "key", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), (F.col("own") > F.col("with")).cast("int").alias("side"))
    plain = spread.join(large, ["t", "key"], "left_anti").select("cid", "copies", "v", "dim", "t", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"))
    units = plain.union(dealt).repartition("dim", "t", "key", "p", "q").sortWithinPartitions("dim", "t", "key", "p", "q", "side")
    found = materialise(units.mapInPandas(_check(depth, tables, threshold, kind), "cid long, links long, root long"), "found")

    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = classes.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    linked = linked.select("v", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.where("sound").join(linked, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
