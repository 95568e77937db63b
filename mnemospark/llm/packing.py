"""Packing documents into sequences along a space-filling curve.

Each document is tokenised once. Its whole stretches of ``SEQUENCE`` ids fill sequences by themselves. What is left of it
is placed on a Hilbert curve: the ids are hashed into a count vector, that is projected to a few dimensions, and the
quantised point's Hilbert key orders the remainders. Spark range-sorts them by this key, and every partition pours its
remainders, in this order, into sequences, cutting where one is full: neighbours along the curve share sequences, and
only the last sequence of a partition is padded. Only remainders, of less than a sequence each, are shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import materialise, mix64, small_batches

SEQUENCE = 1024
END_ID = 0
DIMS, BITS, BUCKETS = 4, 8, 1024
#: Fixed values of byte-level BPE files: the bytes that stand for themselves in a token; the others follow from U+0100 on.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the pattern by which ``ByteLevel`` cuts a text before any merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens of a ``tokenizers`` file by their bytes, if it is plain byte-level BPE whose ids follow the order of merges."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec["normalizer"] is None
    if not plain or model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    byte = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}


class Encoder:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``, as this library gives them without special tokens added.

    The file's merges also run in tiktoken, which is faster and remembers nothing from text to text; ids are the same. Texts
    with the string of an added token, which the tokenizer looks for first, and files of another kind go to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = _ranks(spec)
        self.ranked = Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def ids(self, text: str) -> list[int]:
        if self.ranked is None or any(x in text for x in self.added):
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.ranked.encode_ordinary(text)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The worker's own encoder, which later tasks find."""
    return Encoder(path)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows; ``bits`` bits a dimension), by transposing Gray codes."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] ^= np.where(on, bit - 1, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_BUCKET = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
_DIRECTIONS = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of hashed, normalised id counts projected to ``DIMS`` dimensions."""
    vectors = np.stack([np.bincount(_BUCKET[x & 0xFFFF], minlength=BUCKETS) for x in ids]).astype(np.float32)
    vectors = np.sqrt(vectors)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    points = np.clip((np.tanh(vectors @ _DIRECTIONS * 0.8) + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1)
    return hilbert_key(points.astype(np.int64), BITS)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenise(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sequence = _encoder(path), TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, "text"):
            ids = [np.array([*encoder.ids(t), END_ID], "<u4") for t in batch["text"]]
            cut = [len(x) // SEQUENCE * SEQUENCE for x in ids]
            first = sequence + np.cumsum([0, *(n // SEQUENCE for n in cut)])
            sequence = int(first[-1])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "doc_tokens": [len(x) for x in ids], "place": curve_keys(ids),
                "crcs": [[_crc(x[i : i + SEQUENCE]) for i in range(0, n, SEQUENCE)] for x, n in zip(ids, cut, strict=True)],
                "sequence": first[:-1], "rest": [x[n:].astype("<u4").tobytes() for x, n in zip(ids, cut, strict=True)],
            })

    return run


def _pour(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fill sequences with the remainders of this partition, in their order."""
    number, offset = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        rows = []
        for doc_id, total, rest in zip(batch["doc_id"], batch["doc_tokens"], batch["rest"], strict=True):
            ids = np.frombuffer(rest, "<u4")
            done = 0
            while done < len(ids):
                piece = ids[done : done + SEQUENCE - offset]
                rows.append((doc_id, total - len(ids) + done, len(piece), _crc(piece), total, 2 * number + 1, offset))
                done, offset = done + len(piece), offset + len(piece)
                if offset == SEQUENCE:
                    number, offset = number + 1, 0
        yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file, the same on every executor. A document is its ids, then id 0;
    null and empty texts are that id alone. Null and repeated ids are documents of their own; an empty table gives no
    rows. sequence_id is even for a sequence filled by one document alone, odd for one poured along the curve.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = given.mapInPandas(_tokenise(tokenizer), "doc_id long, doc_tokens long, place long, crcs array<long>, sequence long, rest binary")
    made = materialise(made, "tokens")
    whole = made.where(F.size("crcs") > 0).select("doc_id", "doc_tokens", "sequence", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i") * SEQUENCE).cast("long").alias("start"), F.lit(SEQUENCE).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (2 * (F.col("sequence") + F.col("i"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rests = made.where(F.octet_length("rest") > 0).select("doc_id", "doc_tokens", "place", "rest", F.xxhash64("rest").alias("tie"))
    poured = rests.repartitionByRange("place", "doc_id", "tie").sortWithinPartitions("place", "doc_id", "tie").drop("place", "tie")
    return whole.unionByName(poured.mapInPandas(_pour, PIECES))
