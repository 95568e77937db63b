"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of distinct word shingles. The sketch has ``COORDINATES`` bins. In each of the first rounds an
element falls into a bin drawn by that round's hash; in the later rounds, as many again, round i puts all elements into
bin i. A bin keeps the least (round, hash) it has seen, and sketching a set stops once all its bins are filled, which the
later rounds guarantee. Two sets agree in a bin with a probability of their Jaccard similarity, with concentration.

``ROWS`` bins form a band; documents that agree in a band share a bucket. Documents with equal sets are one class, so that
copies are sketched and compared once. Inside a bucket, sketches (a byte a bin) are compared: members that agree in fewer
bins than ``AGREE`` are far from the threshold and are no candidates. A bucket passes on a spanning forest of its
candidates, found by a search that compares each member only with those not reached yet; a large bucket is dealt out as
pairs of blocks. The forests' components are clusters, all pairs of which are then verified on full sets of the words
themselves: a cluster is dealt into blocks bounded in classes and shingles, each pair of blocks is a unit of work, and a
unit's intersections are products of its presence matrix; it passes on a spanning forest of its links. No link between
candidates is lost, as every pair of classes in a cluster meets in a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import connected_components, discard, materialise, mix64, row_key, small_batches, unused, word_hashes

COORDINATES, ROWS = 192, 6
SIMILAR_PERCENT = 80
BLOCK = 256
#: A block of a cluster has about so many shingles at most, unless one text has more.
SHINGLES = 400_000
COLUMNS = 8192
#: Bins in which the sketches of candidates agree; a pair at the threshold has fewer with a probability of about 1e-10.
AGREE = 115
#: Members of a bucket that meet in one task.
BUCKET = 2048


def shingles(text: str | bytes | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a whole text; a shorter text is one shingle, none without words."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode() if isinstance(text, str) else text
    h = word_hashes(data.lower())
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def named_shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """The shingle sets of some texts as numbers that stand for the words themselves: pairs of names are named, word by word."""
    number: dict[bytes, int] = {}
    said = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(x) for x in said])
    word = np.array([number.setdefault(w, len(number)) for x in said for w in x], np.uint64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(word)) - begin[owner]
    long = sizes >= words
    starts = np.flatnonzero(long[owner] & (place <= sizes[owner] - words))
    name = word[starts]
    for i in range(1, words):
        _, name = np.unique((name << np.uint64(32)) | word[starts + i], return_inverse=True)
        name = name.astype(np.uint64)
    cut = np.searchsorted(owner[starts], np.arange(len(texts) + 1))
    short: dict[tuple, int] = {}
    alone = lambda x: np.array([(1 << 62) + short.setdefault(tuple(x), len(short))], np.uint64)
    return [np.unique(name[cut[i] : cut[i + 1]]) if long[i] else alone(x) if x else np.empty(0, np.uint64) for i, x in enumerate(said)]


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """[set, bin] sketches of non-empty sets, all sets of a batch in one sweep of rounds."""
    out = np.full(len(sets) * size, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    filled = np.zeros(len(sets) * size, bool)
    element = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    open_ = np.ones(len(sets), bool)
    rounds = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for turn in range(2 * size):
        live = open_[owner]
        if not live.all():
            element, owner = element[live], owner[live]
        if not len(element):
            break
        h = mix64(element ^ rounds[turn])
        to = owner * size + ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64) if turn < size else owner * size + turn - size
        if turn >= size:
            need = ~filled[to]
            to, h = to[need], h[need]
        value = (np.uint64(turn) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(out, to, value)
        filled[to] = True
        open_ = ~filled.reshape(len(sets), size).all(1)
    return out.reshape(len(sets), size)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[set, band] keys."""
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def _sketch(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches, "text"):
            sets = [shingles(t, words) for t in batch["text"]]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, bytes_ = [None] * len(sets), [None] * len(sets)
            if some:
                made = sketches([sets[i] for i in some])
                low = (made & np.uint64(255)).astype(np.uint8)
                for i, k, b in zip(some, bands(made), low, strict=True):
                    keys[i], bytes_[i] = k, b.tobytes()
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "row_key": batch["row_key"], "n_shingles": [len(s) for s in sets],
                "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "bands": keys, "sketch": bytes_,
            })

    return run


def forest(sketch: np.ndarray, side: np.ndarray | None = None, least: int = AGREE) -> list[tuple[int, int]]:
    """A spanning forest of the rows that agree in ``least`` places, of different sides only if there are two.

    Every row is compared once, with the rows not reached yet, so that a bucket of rows that are all alike takes one pass.
    """
    out, left = [], np.arange(len(sketch))
    while len(left):
        at, left = [int(left[0])], left[1:]
        while at and len(left):
            x = at.pop()
            near = (sketch[left] == sketch[x]).sum(1) >= least
            if side is not None:
                near &= side[left] != side[x]
            found = left[near].tolist()
            out += [(x, y) for y in found]
            at += found
            left = left[~near]
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of whole buckets, or of pairs of blocks of a large one; the rows of a unit stand together."""
    held: pd.DataFrame | None = None

    def closed(rows: pd.DataFrame) -> pd.DataFrame:
        marks = rows[["band", "p", "q"]].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(rows)]))
        cid, side = rows["cid"].to_numpy(), rows["side"].to_numpy()
        table = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        links = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                links += [(cid[a + x], cid[a + y]) for x, y in forest(table[a:b], None if marks[a, 1] == marks[a, 2] else side[a:b])]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64").drop_duplicates()

    for batch in batches:
        rows = batch if held is None or not len(held) else pd.concat((held, batch))
        if not len(rows):
            continue
        marks = rows[["band", "p", "q"]].to_numpy()
        last = int(np.argmax((marks == marks[-1]).all(1)))  # the last unit may go on
        if last:
            yield closed(rows.iloc[:last])
        held = rows.iloc[last:]
    if held is not None and len(held):
        yield closed(held)


def link_unit(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one unit: between the sets marked ``left`` and the others, or, if all are, among all."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets)
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a = np.flatnonzero(left)
    b = a if left.all() else np.flatnonzero(~left)
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(used), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((n, min(COLUMNS, len(used) - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x[a] @ x[b].T
    sizes = np.array([len(s) for s in sets], np.float64)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    i, j = np.nonzero(100 * both.astype(np.float64) >= percent * union)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True):
        rp, rq = find(p), find(q)
        if rp != rq:
            parent[rp] = rq
            out.append((int(ids[p]), int(ids[q])))
    return out


def _verify(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, texts, sides, seen = None, [], [], [], set()

        def closed() -> pd.DataFrame:
            left = np.array(sides) == 0
            meets = len(ids) > 1 and left.any() and (key[1] == key[2] or not left.all())
            links = link_unit(np.array(ids), named_shingles(texts, words), left, percent) if meets else []
            return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

        for batch in batches:
            for cluster, p, q, side, cid, text in batch[["cluster", "p", "q", "side", "cid", "text"]].itertuples(index=False, name=None):
                if (cluster, p, q) != key:
                    if key is not None:
                        yield closed()
                    key, ids, texts, sides, seen = (cluster, p, q), [], [], [], set()
                if cid in seen:  # a row that repeats in the input
                    continue
                seen.add(cid)
                ids.append(cid)
                texts.append(text)
                sides.append(side)
        if key is not None:
            yield closed()

    return run


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Members of a group to the pairs of its blocks: p, q and the side in the pair; each member's block follows from its cid."""
    own = F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    out = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return out.withColumns({"p": F.least("own", "with"), "q": F.greatest("own", "with"), "side": (F.col("own") > F.col("with")).cast("int")}).drop("own", "with", blocks)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = SIMILAR_PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, row_key.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; a text with fewer than
    ``words`` words is one shingle; one without words, or null, has none and links with nothing. component_id is the
    smallest known id that is reachable (null if none is known), kept says whether the row has it. Null and repeated ids
    are rows of their own; repeated rows with the smallest id are each kept. An empty table gives no rows. row_key names a
    row by id and whole text.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"))
    rows = given.mapInPandas(_sketch(words), "doc_id long, row_key string, n_shingles long, same binary, bands array<long>, sketch binary")
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "sketches")

    # a class is named by one of its rows; cid and row_key belong to the same row
    classes = rows.where("same is not null").groupBy("same").agg(F.min(F.struct("rid", "row_key")).alias("first"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"))
    classes = materialise(classes.select("same", F.col("first.rid").alias("cid"), F.col("first.row_key").alias("row_key"), "least", "n_shingles"), "classes")
    named = rows.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi")
    keyed = named.select(F.col("rid").alias("cid"), F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").select("band", "blocks")
    shared = materialise(_dealt(keyed.join(buckets, "band"), "blocks"), "buckets")
    sketch = named.select(F.col("rid").alias("cid"), "sketch")
    units = shared.join(sketch, "cid").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    candidates = materialise(units.mapInPandas(_candidates, "a long, b long").distinct(), "candidates")
    discard(shared)
    clusters = materialise(connected_components(candidates).select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "clusters")
    discard(candidates)

    members = clusters.join(classes.select("cid", "row_key", "n_shingles"), "cid")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / SHINGLES)).cast("int").alias("blocks"))
    member = _dealt(members.drop("n_shingles").join(sizes, "cluster"), "blocks")
    units = given.select("row_key", "text").join(member, "row_key").select("cluster", "p", "q", "side", "cid", "text")
    units = units.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    links = materialise(units.mapInPandas(_verify(words, percent), "a long, b long"), "links")

    parts = connected_components(links).withColumnRenamed("node", "cid")
    placed = classes.join(parts, "cid", "left").select("same", "least", F.coalesce("component", "cid").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select("same", "component_id")
    linked = rows.where("same is not null").join(placed, "same").select("doc_id", "n_shingles", "component_id", "row_key")
    alone = rows.where("same is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key")
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that near dedup keeps, with all their columns, of whatever names.

    Null and empty texts have no words, link with nothing and stay, if their id is known; so does each of repeated rows
    with the smallest id. An empty table gives no rows.
    """
    row, kept = unused(docs, "row", "kept_row")
    found = near_dedup(docs, id_col, text_col, **rules).where("kept").select(F.col("row_key").alias(kept))
    return docs.withColumn(row, row_key(F.col(id_col).cast("long"), F.col(text_col))).join(found, F.col(row) == F.col(kept), "left_semi").select(docs.columns)
