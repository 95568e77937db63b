"""Removal of repeated byte strings by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier in the corpus. Not every suffix needs to
be sorted for this: in every window, the ``GRAM``-byte string with the least hash is an anchor, and equal windows have
their anchors at equal places. So only anchors are compared, and only those whose gram occurs more than once.

1. Anchors are sorted by gram and by a hash of their context (all windows that hold the anchor), by each task for what it
   read, then, after a shuffle, for all that came first in a task; so a passage that very many documents share reaches the
   task of its gram once a task. What repeats an earlier context is covered as a whole. First occurrences whose gram also
   has other contexts are edges of repeats.
2. The suffixes at the edges, and the reversed texts before them, are sorted: multikey quicksort, with eight bytes as a
   character, to the depth ``SHALLOW``; groups that still agree there are ordered by blind tries. In both orders, common
   prefixes of neighbours give for each offset of a window the classes of equal right and left parts, hence the classes of
   equal windows; all but the earliest of a class are repeats.

Contexts are told apart by 64-bit hashes; edges are compared by their bytes. Edges of one gram are sorted in one task up
to ``HOT`` of them; the windows of hotter grams are compared by a distributed aggregation over their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import Hasher, discard, materialise, mix64

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM
SHALLOW = 3
SEGMENT = 1 << 19
GROUPED = 8192
#: Anchors that a task sorts at a time before the shuffle.
LOCAL = 400_000
HOT = 200_000


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of the anchors of all windows of one text, in segments of bounded memory.

    An anchor may come twice where segments meet.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
    for first in range(0, len(data) - WINDOW + 1, SEGMENT):
        low = max(0, first - REACH)
        part = data[low : first + SEGMENT + 2 * WINDOW]
        prefix = hasher.prefix(part)
        starts = np.arange(len(part) - GRAM + 1)
        grams = hasher.slices(prefix, starts, starts + GRAM)
        inner = grams[first - low : first - low + SEGMENT + REACH]  # grams of the windows that start in this segment
        width = REACH + 1
        least = _sliding(inner, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(inner == _sliding(np.concatenate((pad, least, pad)), width, np.maximum)) + first - low
        contexts = hasher.slices(prefix, np.maximum(0, at - REACH), np.minimum(len(part), at + WINDOW))
        left = np.minimum(at, REACH).astype(np.uint64)  # a text's begin inside the context is part of it
        out.append((at + low, grams[at], mix64(contexts ^ left)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ANCHORS = "key long, ctx long, doc_id long, dk long, pos long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors; those that repeat the context of an earlier one of the same task come without key and context."""
    hasher = Hasher(1 << 16)
    parts: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        key, ctx, doc, known, dk, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, dk, doc, known, ctx, key))
        key, ctx, doc, known, dk, pos = (x[order] for x in (key, ctx, doc, known, dk, pos))
        before = lambda x: np.concatenate(([False], x[1:] == x[:-1]))
        same = before(key) & before(ctx)
        twice = same & before(dk) & before(pos) & before(doc) & before(known)  # where segments meet, or a row repeats
        kept = ~twice
        null = same[kept]
        values = lambda x, mask=None: pa.array(x[kept], pa.int64(), mask=mask)
        return pa.RecordBatch.from_arrays([values(key, null), values(ctx, null), values(doc, ~known[kept]), values(dk), values(pos)], names=[x.split()[0] for x in ANCHORS.split(", ")])

    for batch in batches:
        texts, docs, dks = batch.column("bytes"), batch.column("doc_id"), batch.column("dk").to_numpy(zero_copy_only=False)
        known, docs = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy(zero_copy_only=False)
        for i in range(len(texts)):
            data = np.frombuffer(texts[i].as_buffer(), np.uint8)
            if len(data) >= WINDOW:
                pos, key, ctx = anchors(data, hasher)
                n = len(pos)
                parts.append((key.view(np.int64), ctx.view(np.int64), np.full(n, docs[i]), np.full(n, known[i]), np.full(n, dks[i]), pos))
                held += n
            if held > LOCAL:
                yield made()
                parts, held = [], 0
    if held:
        yield made()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in order: repeats of a context (key null), and edges (with their key)."""
    names = ["key", "ctx", "doc_id", "dk", "pos"]
    waiting: pa.RecordBatch | None = None  # the last row of what came before
    single = False  # whether it belongs to the first context of its gram
    first: pa.RecordBatch | None = None  # that context's first row
    for batch in batches:
        known = batch.column("key").is_valid()
        if batch.column("key").null_count:
            yield _marks(batch, np.flatnonzero(~known.to_numpy(zero_copy_only=False)), False)
            batch = batch.filter(known)
        if not batch.num_rows:
            continue
        whole = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        skip = int(waiting is not None)
        key, ctx, dk, pos = (whole.column(n).to_numpy(zero_copy_only=False) for n in ("key", "ctx", "dk", "pos"))
        doc = whole.column("doc_id").fill_null(0).to_numpy()
        before = lambda x: np.concatenate(([False], x[1:] == x[:-1]))
        same_key = before(key)
        same = same_key & before(ctx)
        again = same & before(dk) & before(pos) & before(doc)
        repeats = np.flatnonzero(same & ~again)
        starts = np.flatnonzero(~same)
        if skip:
            starts = starts[starts > 0]
            if single and len(starts) and same_key[starts[0]]:
                yield _marks(first, np.array([0]), True)
        follow = np.append(same_key[starts[1:]], False) if len(starts) else np.empty(0, bool)
        edges = starts[same_key[starts] | follow]
        if len(repeats):
            yield _marks(whole, repeats, False)
        if len(edges):
            yield _marks(whole, edges, True)
        if len(starts):
            last = starts[-1]
            single = not same_key[last]
            first = whole.slice(last, 1)
        elif not skip:
            single, first = True, whole.slice(0, 1)
        waiting = whole.slice(whole.num_rows - 1, 1)
        assert whole.schema.names == names


def _marks(batch: pa.RecordBatch, at: np.ndarray, edge: bool) -> pa.RecordBatch:
    rows = batch.take(pa.array(at))
    keys = rows.column("key") if edge else pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("dk"), rows.column("pos"), keys], names=["doc_id", "dk", "pos", "key"])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; runs that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def _digest(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    kept, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.update(data[at:s])
        at = e
    kept.update(data[at:])
    return int((ends - starts).sum()), len(starts), kept.hexdigest()


COVERED = "doc_id long, dk long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, bytes binary, edge_pos array<long>, edge_key array<long>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without edges are done; others pass on with what is covered so far."""
    for batch in batches:
        rows, size = [], 0
        for doc_id, dk, data, full, pos, keys in batch[["doc_id", "dk", "bytes", "full", "pos", "keys"]].itertuples(index=False, name=None):
            full = np.array([] if full is None else full, np.int64)
            starts, ends = merged(np.maximum(0, full - REACH), np.minimum(len(data), full + WINDOW))
            spans = np.stack((starts, ends), 1).ravel()
            if pos is not None and len(pos):
                rows.append((doc_id, dk, len(data), None, None, None, spans, data, pos, keys))
                size += len(data)
            else:
                rows.append((doc_id, dk, len(data), *_digest(data, starts, ends), spans, None, None, None))
            if size > 8_000_000:
                yield _frame(rows)
                rows, size = [], 0
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(COVERED)).astype({"doc_id": "Int64", "n_removed": "Int64", "n_spans": "Int64"})


EDGES = "key long, doc_id long, dk long, rid long, pos long, left binary, right binary"


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An edge's text before it, reversed, and its suffix, both as far as a window reaches."""
    for batch in batches:
        rows = []
        for doc_id, dk, rid, data, places, keys in batch[["doc_id", "dk", "rid", "bytes", "edge_pos", "edge_key"]].itertuples(index=False, name=None):
            rows += [(k, doc_id, dk, rid, p, data[max(0, p - REACH) : p][::-1], data[p : p + WINDOW]) for p, k in zip(places.tolist(), keys.tolist(), strict=True)]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=_names(EDGES)).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_names(EDGES)).astype({"doc_id": "Int64"})


def _blind_trie(group: list[int], strings: list[bytes], numbers: list[int], bits: int) -> list[int]:
    """The group in order. Inner nodes hold only the depth at which their strings part and a child for each byte there.

    A string goes down blindly, comparing single bytes, to some leaf; one comparison with that leaf gives the depth at
    which it parts from the trie, and a second descent to that depth gives its place.
    """
    root: list | dict = [group[0]]
    for i in group[1:]:
        node, s = root, strings[i]
        while isinstance(node, dict):
            node = node["kids"].get(s[node["depth"]]) or next(iter(node["kids"].values()))
        other = node[0]
        apart = numbers[i] ^ numbers[other]
        if not apart:
            node.append(i)
            continue
        depth = (bits - apart.bit_length()) >> 3
        above, node = None, root
        while isinstance(node, dict) and node["depth"] < depth:
            above, node = node, node["kids"][s[node["depth"]]]
        if isinstance(node, dict) and node["depth"] == depth:
            node["kids"][s[depth]] = [i]
            continue
        made = {"depth": depth, "kids": {s[depth]: [i], strings[other][depth]: node}}
        if above is None:
            root = made
        else:
            above["kids"][s[above["depth"]]] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            stack.extend(node["kids"][b] for b in sorted(node["kids"], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_sort(table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of byte strings: rows of ``table``, padded with zeros to whole words.

    Strings that differ in padding only stand by length, and a common prefix never exceeds either length.
    """
    n, width = table.shape
    words = table.view(">u8").astype(np.uint64)
    rows = [r.tobytes() for r in table]
    numbers = [int.from_bytes(r, "big") for r in rows]
    by_length = np.argsort(lengths, kind="stable")
    order, stack = [], [(by_length, 0)] if n else []
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order.append(int(group[0]))
        elif depth == min(SHALLOW, words.shape[1]):
            order += _blind_trie(group.tolist(), rows, numbers, 8 * width) if depth < words.shape[1] else group.tolist()
        else:
            values = words[group, depth]
            pivot = values[len(values) // 2]
            for part, at in ((values > pivot, depth), (values == pivot, depth + 1), (values < pivot, depth)):
                if part.any():
                    stack.append((group[part], at))
    order = np.array(order, np.int64)
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = table[order[1:]] != table[order[:-1]]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, common


def _table(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width = -(-max(1, width) // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), np.array([len(s) for s in strings])


def repeated_offsets(left: list[bytes], right: list[bytes], document: np.ndarray, start: np.ndarray) -> np.ndarray:
    """[edge, offset]: whether the window that begins ``offset`` before the edge equals that of an earlier edge.

    Edges stand in order of document and start; ``document`` numbers their documents.
    """
    n = len(left)
    parts = []
    for strings, width in ((left, REACH), (right, WINDOW)):
        table, lengths = _table(strings, width)
        order, common = deep_shallow_sort(table, lengths)
        parts.append((order, common, lengths))
    (lo, lc, ll), (ro, rc, rl) = parts
    out = np.zeros((n, REACH + 1), bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(REACH + 1):
        a[lo] = np.cumsum(lc < offset)
        b[ro] = np.cumsum(rc < WINDOW - offset)
        whole = np.flatnonzero((ll >= offset) & (rl >= WINDOW - offset))
        _, first, back = np.unique(a[whole] * (n + 1) + b[whole], return_index=True, return_inverse=True)
        first = whole[first][back]
        out[whole, offset] = (document[first] != document[whole]) | (start[first] != start[whole])
    return out


def _edge_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = pd.MultiIndex.from_arrays([rows["doc_id"].fillna(0), rows["dk"]])
        rows = rows.assign(known=rows["doc_id"].notna(), document=pairs.factorize()[0]).sort_values(["known", "doc_id", "dk", "pos"], kind="stable")
        pos = rows["pos"].to_numpy()
        found = repeated_offsets(rows["left"].tolist(), rows["right"].tolist(), rows["document"].to_numpy(), pos)
        padded = np.zeros((len(rows), REACH + 3), bool)
        padded[:, 1:-1] = found
        i, low = np.nonzero(~padded[:, :-1] & padded[:, 1:])
        _, high = np.nonzero(padded[:, :-1] & ~padded[:, 1:])
        return pd.DataFrame({"rid": rows["rid"].to_numpy()[i], "start": pos[i] - high + 1, "end": pos[i] - low + WINDOW})

    for batch in batches:
        held.append(batch)
        rows = pd.concat(held) if len(held) > 1 else batch
        if len(rows) >= GROUPED:
            keys = rows["key"].to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])  # the last gram may go on
            if cut:
                yield spans(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
    if held:
        rows = pd.concat(held)
        if len(rows):
            yield spans(rows)


def _hot_spans(edges: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: windows meet by their bytes, with map-side minima."""
    start = F.struct("doc_id", "dk", (F.col("pos") - F.col("offset")).alias("start"))
    offsets = edges.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(REACH))))
    offsets = offsets.where("octet_length(left) >= offset and octet_length(right) >= %d - offset" % WINDOW)
    windows = offsets.select("rid", start.alias("at"), F.substring("left", 1, F.col("offset")).alias("l"), F.substring("right", F.lit(1), WINDOW - F.col("offset")).alias("r"), "offset")
    earliest = windows.groupBy("l", "r").agg(F.min("at").alias("first"))
    found = windows.join(earliest, ["l", "r"]).where("at <> first")
    return found.select("rid", F.col("at.start").alias("start"), (F.col("at.start") + WINDOW).alias("end"))


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, data, spans, more in batch[["doc_id", "bytes", "spans", "more"]].itertuples(index=False, name=None):
            old = np.asarray(spans, np.int64).reshape(-1, 2)
            new = np.array([(m["start"], m["end"]) for m in more], np.int64).reshape(-1, 2) if more is not None else old[:0]
            starts, ends = merged(np.concatenate((old[:, 0], new[:, 0])), np.concatenate((old[:, 1], new[:, 1])))
            rows.append((doc_id, len(data), *_digest(data, starts, ends), np.stack((starts, ends), 1).ravel()))
        yield pd.DataFrame(rows, columns=_names(RESULT)).astype({"doc_id": "Int64"})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end bytes in turn).

    Texts are UTF-8 bytes, null is empty. Documents are in the order of their ids, null first, then of a hash of id and
    text; rows that repeat both are one document, and each gives its result. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("dk"), text.cast("binary").alias("bytes"))
    found = given.mapInArrow(_anchor_rows, ANCHORS)
    found = found.repartition(F.coalesce("key", F.xxhash64("dk", "pos"))).sortWithinPartitions("key", "ctx", "doc_id", "dk", "pos")
    marks = materialise(found.mapInArrow(_resolve, "doc_id long, dk long, pos long, key long"), "marks")
    per = marks.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("pos", "key")).alias("marks"))
    edge = F.filter("marks", lambda m: m["key"].isNotNull())
    per = per.select(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), F.filter("marks", lambda m: m["key"].isNull())["pos"].alias("full"), edge["pos"].alias("pos"), edge["key"].alias("keys"))
    joined = given.join(per, (F.col("dk") == F.col("_dk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_dk")
    covered = materialise(joined.mapInPandas(_cover, COVERED).withColumn("rid", F.monotonically_increasing_id()), "covered")
    discard(marks)

    open_ = covered.where("bytes is not null")
    edges = open_.mapInPandas(_contexts, EDGES)
    hot_keys = open_.select(F.explode("edge_key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    hot_keys = materialise(hot_keys, "hot")
    if hot_keys.isEmpty():
        spans = edges.repartition("key").sortWithinPartitions("key").mapInPandas(_edge_spans, "rid long, start long, end long")
    else:
        usual = edges.join(hot_keys, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        spans = usual.mapInPandas(_edge_spans, "rid long, start long, end long").union(_hot_spans(edges.join(hot_keys, "key", "left_semi")))
    spans = materialise(spans, "spans")
    more = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    ended = open_.join(more, "rid", "left").mapInPandas(_finish, RESULT)
    return covered.where("bytes is null").select(_names(RESULT)).union(ended)
