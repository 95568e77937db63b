"""Phrase collocation mining by a multikey quicksort of suffixes, routed by their leading words.

The suffix at a word is that word and the up to four that follow it in its piece of text. Three steps:

1. Words and pairs of neighbours are counted by a hash of 32 bits and more, in shards of hashes. Of those with the least
   count a bitmap is made, of at most ``MOST_BITS`` places. A word or pair whose place is empty is in no frequent phrase: a
   suffix ends before such a pair, and does not begin at such a word. Where a corpus has so many frequent pairs that the bitmap
   fills, it excludes less, and results stay the same.
2. Equal suffixes of a few megabytes of text become one row with their number. Rows are routed by ranges of their words, so
   that very frequent leading words go on to several tasks, each with other following words.
3. A task sorts its suffixes by multikey three-way quicksort, word by word to the last: the weight of an equal partition is
   the count of a phrase, and partitions lighter than the least count are abandoned. Only the phrases that begin the first
   and the last suffix of a range may go on in a neighbouring one; their counts are added up.

Scores, the choice of cuts, and the removal of phrases inside longer ones are joins of counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import discard, materialise, mix64
from mnemospark.llm.words import joined, numbered, runs

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bytes of text for a shard of hashes, and the least and most shards; powers of two.
SHARE, LEAST_SHARDS, MOST_SHARDS = 1 << 28, 256, 1 << 14
#: Hashes that one task counts, about; places of the bitmap, 64 times as many as there are frequent hashes within these bounds.
ENTRIES, LEAST_BITS, MOST_BITS = 8_000_000, 1 << 20, 1 << 28
#: Bytes of text that a task turns into suffixes at a time, and suffixes that one range has, about.
CHUNK, RANGE = 4_000_000, 200_000
#: Salts of the first ranking of a language's phrases.
SALTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: What parts words inside a piece, and what ends a piece.
GAP = np.isin(np.arange(256), [0x20, 0x09])
STOP = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])


class Words:
    """The words of some texts: numbers, languages, whether the next word is in the same piece, whether a suffix begins here."""

    def __init__(self, texts: list[bytes], langs: list[str], owned: list[int]):
        data, begins = joined(texts)
        data = LOWER[data]
        inside = ~(GAP | STOP)[data]
        starts, ends = runs(inside)
        text = np.searchsorted(begins, starts, "right") - 1
        self.ids, self.words = numbered(data, inside, starts, ends)
        names, codes = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.empty(0, str), np.empty(0, np.int64))
        self.names, self.lang = names, codes[text]
        stops = np.flatnonzero(STOP[data])
        between = np.searchsorted(stops, starts)
        self.next = np.append(between[1:] == between[:-1], False) if len(starts) else np.empty(0, bool)
        last = np.cumsum(np.bincount(text, minlength=len(texts)))[text]
        self.owned = last - np.arange(len(text)) > np.array(owned, np.int64)[text] if len(texts) else np.empty(0, bool)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word, and of the pair it makes with the next, in its language."""
        hashed = pd.util.hash_array(np.array(self.words.to_pylist(), object), categorize=False) if len(self.words) else np.empty(0, np.uint64)
        tongue = pd.util.hash_array(self.names.astype(object), categorize=False) if len(self.names) else np.empty(0, np.uint64)
        one = mix64(hashed[self.ids] ^ tongue[self.lang])
        return one, mix64(one * np.uint64(0x9E3779B97F4A7C15) + np.append(one[1:], one[:1]))


def _pieces(text: bytes, size: int, most: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts, and how many of a part's last words begin no suffix there, as the next part repeats them.

    Parts end where a piece ends, or else between words.
    """
    at = 0
    while len(text) - at > size:
        window = np.frombuffer(text, np.uint8, size, at)
        cut = np.flatnonzero(STOP[window])
        if len(cut):
            yield text[at : at + int(cut[-1]) + 1], 0
            at += int(cut[-1]) + 1
            continue
        end = at + size
        while end < len(text) and not (GAP[text[end]] or STOP[text[end]]):
            end += 1
        if end == len(text):
            break
        starts, _ = runs(~GAP[np.frombuffer(text, np.uint8, end - at, at)] & ~STOP[np.frombuffer(text, np.uint8, end - at, at)])
        if len(starts) <= most - 1:  # a few very long words: take more of them at a time
            size *= 2
            continue
        yield text[at:end], most - 1
        at += int(starts[1 - most])
    yield text[at:], 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int, size: int = CHUNK) -> Iterator[Words]:
    texts, langs, owned, held = [], [], [], 0
    for batch in batches:
        values, tongues = batch.column("bytes"), batch.column("lang")
        for i in range(batch.num_rows):
            for part, rest in _pieces(values[i].as_py(), size, most):
                texts.append(part)
                langs.append(tongues[i].as_py())
                owned.append(rest)
                held += len(part)
                if held >= size:
                    yield Words(texts, langs, owned)
                    texts, langs, owned, held = [], [], [], 0
    if texts:
        yield Words(texts, langs, owned)


COUNTED = "lang string, n long, shard int, hashes binary, counts binary"


def _hashed(least: int, most: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each language; and, of a chunk, how often its hashes occur (up to ``least``), shard by shard."""
        shift = np.uint64(32 - shards.bit_length() + 1)
        seen: dict[str, int] = {}
        for w in _chunks(batches, most):
            one, two = w.hashes()
            keys, found = np.unique(np.concatenate((one[w.owned], two[w.owned & w.next])) >> shift, return_counts=True)
            for code, n in enumerate(np.bincount(w.lang[w.owned], minlength=len(w.names)).tolist()):
                seen[str(w.names[code])] = seen.get(str(w.names[code]), 0) + n
            shard = (keys >> np.uint64(32)).astype(np.int32)
            ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)) if len(shard) else np.empty(0, np.int64)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            packed = lambda values, width: pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets * width), pa.py_buffer(values)])
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(shard[offsets[:-1]] if n else shard), packed((keys & np.uint64(0xFFFFFFFF)).astype("<u4"), 4), packed(np.minimum(found, least).astype(np.uint8), 1),
            ], names=["lang", "n", "shard", "hashes", "counts"])
        k = len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=["lang", "n", "shard", "hashes", "counts"])

    return run


def _frequent(least: int, room: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards in order: their hashes that have the least count. Equal hashes are added up as soon as ``room`` of them are held."""
        now, parts, held = None, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[order], counts[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            return hashes[new], np.minimum(np.add.reduceat(counts, new), least).astype(np.uint8)

        def done() -> pa.RecordBatch:
            hashes, counts = summed()
            kept = hashes[counts >= least]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([kept.tobytes()], pa.binary())], names=["shard", "n", "hashes"])

        for batch in batches:
            for shard, hashes, counts in zip(batch.column("shard").to_pylist(), batch.column("hashes"), batch.column("counts"), strict=True):
                if shard != now:
                    if parts:
                        yield done()
                    now, parts, held = shard, [], 0
                parts.append((np.frombuffer(hashes.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), np.uint8)))
                held += len(parts[-1][0])
                if held > room:
                    parts = [summed()]
                    held = len(parts[0][0]) // 2  # what cannot be added up counts half
        if parts:
            yield done()

    return run


def _bits(shards: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of the bitmap that a shard's hashes are in."""
        width = places // shards
        for batch in batches:
            rows = []
            for hashes in batch.column("hashes"):
                part = np.zeros(width, bool)
                part[(np.frombuffer(hashes.as_buffer(), "<u4").astype(np.uint64) * np.uint64(width)) >> np.uint64(32)] = True
                rows.append(np.packbits(part).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(rows, pa.binary())], names=["shard", "bits"])

    return run


SUFFIXES = "lang string, suffix string, n long"


def _suffixes(frequent, most: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes as far as they may be frequent, equal ones of a chunk as one row; every word ends with a line feed."""
        bits, shift = np.frombuffer(frequent.value, np.uint8), np.uint64(64 - places.bit_length() + 1)
        full = lambda hashes: (bits[(at := hashes >> shift) >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        for w in _chunks(batches, most):
            one, two = w.hashes()
            n, alive, pair = len(w.ids), full(one), w.next & full(two)
            at = np.flatnonzero(alive & w.owned)
            if not len(at):
                continue
            table, going = np.full((len(at), most), -1, np.int32), np.ones(len(at), bool)
            table[:, 0] = w.ids[at]
            for k in range(1, most):
                before = np.minimum(at + k - 1, n - 1)
                going = going & (at + k < n) & pair[before] & alive[np.minimum(at + k, n - 1)]
                table[going, k] = w.ids[at[going] + k]
            lang = w.lang[at]
            keys = [lang, *table.T]
            packed = [(a.astype(np.int64) << 32) + b + 1 for a, b in zip(keys[::2], keys[1::2], strict=False)] + ([keys[-1]] if len(keys) % 2 else [])
            order = np.lexsort(packed[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([p[order[1:]] != p[order[:-1]] for p in packed], axis=0)
            first = order[new]
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            words = pc.binary_join_element_wise(w.words, pa.scalar(b""), pa.scalar(b"\n"))
            parts = [words.take(pa.array(np.maximum(table[first, k], 0), mask=table[first, k] < 0)) for k in range(most)]
            for low in range(0, len(first), 50_000):
                some = slice(low, low + 50_000)
                text = pc.binary_join_element_wise(*[p[some] for p in parts], pa.scalar(b""), null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array(w.names[lang[first[some]]].astype(object), pa.string()), text.cast(pa.string()), pa.array(counts[some])], names=["lang", "suffix", "n"])

    return run


PHRASES = "lang string, phrase string, words int, f long"


def multikey_quicksort(table: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, words, weight) of the equal partitions that weigh ``least`` or more, for rows of numbers that end with -1.

    A partition is split in three by a pivot at its depth; the equal part goes on one word deeper. Lighter parts are abandoned.
    """
    out, stack = [], [(np.arange(len(table)), 0)] if len(table) and weight.sum() >= least else []
    while stack:
        group, depth = stack.pop()
        values = table[group, depth]
        pivot = values[len(values) // 2]
        for part, deeper in ((values < pivot, 0), (values == pivot, 1), (values > pivot, 0)):
            rows = group[part]
            if not len(rows) or (total := int(weight[rows].sum())) < least:
                continue
            if not deeper:
                stack.append((rows, depth))
            elif pivot >= 0:  # else these suffixes have ended
                out.append((int(rows[0]), depth + 1, total))
                if depth + 1 < table.shape[1]:
                    stack.append((rows, depth + 1))
    return out


def _counted(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases of one range; those at its ends whatever they are."""
        whole = pa.Table.from_batches(list(batches), pa.schema([("lang", pa.string()), ("suffix", pa.string()), ("n", pa.int64())])).combine_chunks()
        if not whole.num_rows:
            return
        lang, suffix, weight = (whole.column(c).combine_chunks() for c in ("lang", "suffix", "n"))
        split = pc.split_pattern(suffix, "\n")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False) - 1  # the last is empty
        flat = pc.list_flatten(split)
        coded = flat.dictionary_encode()
        ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        begins = np.cumsum(sizes + 1) - sizes - 1
        table = np.full((len(sizes), most), -1, np.int64)
        for k in range(most):
            some = sizes > k
            table[some, k] = ids[begins[some] + k]
        tongue = lang.dictionary_encode()
        names, tongues = tongue.dictionary.to_pylist(), tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weight = weight.to_numpy(zero_copy_only=False)
        keyed = table.copy()
        keyed[:, 0] += tongues * len(words)  # the first word, of its language
        found = {(names[tongues[row]], "\n".join(words[i] for i in table[row, :depth])): (depth, n) for row, depth, n in multikey_quicksort(keyed, weight, least)}
        ends = pc.sort_indices(whole.select(["lang", "suffix"]), [("lang", "ascending"), ("suffix", "ascending")])
        for row in (ends[0].as_py(), ends[-1].as_py()):
            for depth in range(1, int(sizes[row]) + 1):
                alike = (keyed[:, :depth] == keyed[row, :depth]).all(1)
                found[names[tongues[row]], "\n".join(words[i] for i in table[row, :depth])] = (depth, int(weight[alike].sum()))
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1].replace("\n", " ") for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int32()), pa.array([v[1] for _, v in rows], pa.int64()),
        ], names=["lang", "phrase", "words", "f"])

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST_WORDS, rows: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``most`` words with ``least`` occurrences, and (lang, n) of all words.

    ``least`` is from 1 to 255. Null texts are empty, a null language is ``und``.
    """
    if not 1 <= least <= 255:
        raise ValueError("the least count is from 1 to 255")
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    power = lambda x, low, high: 1 << min(high, max(low, int(x) - 1)).bit_length() if x > low else low
    size = given.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = power(size // SHARE, LEAST_SHARDS, MOST_SHARDS - 1)
    counted = materialise(given.mapInArrow(_hashed(least, most, shards), COUNTED), "counted")
    totals = materialise(counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    tasks = max(1, (counted.agg(F.sum(F.octet_length("counts"))).first()[0] or 0) // ENTRIES)
    found = counted.where("shard is not null").select("shard", "hashes", "counts").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_frequent(least), "shard int, n long, hashes binary")
    found = materialise(found, "frequent")
    discard(counted)
    places = power(64 * (found.agg(F.sum("n")).first()[0] or 0), LEAST_BITS, MOST_BITS - 1)
    width, bits = places // shards // 8, bytearray(places // 8)
    for r in found.mapInArrow(_bits(shards, places), "shard int, bits binary").toLocalIterator():  # 32 MB at most
        bits[r["shard"] * width : (r["shard"] + 1) * width] = r["bits"]
    discard(found)
    suffixes = materialise(given.mapInArrow(_suffixes(spark.sparkContext.broadcast(bytes(bits)), most, places), SUFFIXES), "suffixes")
    ranges = max(1, -(-suffixes.count() // rows))
    parts = suffixes.repartitionByRange(ranges, "lang", "suffix").mapInArrow(_counted(least, most), PHRASES)
    phrases = materialise(parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    discard(suffixes)
    return phrases, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``most`` words.

    Null texts are empty, a null language is ``und``; repeated rows count again; languages without a frequent phrase, and
    empty tables, give no rows. Other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least, most)
    long = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    head, tail = F.array_join(F.slice("w", 1, F.col("words") - 1), " "), F.array_join(F.slice("w", 2, F.col("words") - 1), " ")
    inner = long.where("words > 2").select("lang", "a", F.explode(F.array(head, tail)).alias("phrase")).distinct()
    kept = long.join(inner, ["lang", "phrase", "a"], "left_anti")

    cut = kept.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cut = cut.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    product = "cast(cast({} as decimal(19,0)) * cast({} as decimal(19,0)) as decimal(38,0))"
    score = F.expr(f"cast(1000 * {product.format('a', 'n')} as decimal(38,0)) div {product.format('l', 'r')}")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))
    few = best.withColumn("rank", salted).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
