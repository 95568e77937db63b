"""Words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that part words in most operators: space, tab, LF, VT, FF and CR.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind each other, a line feed between two; and where each begins."""
    texts = [t or b"" for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)[:-1]
    return np.frombuffer(b"\n".join(texts), np.uint8), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    if len(inside) and inside[-1]:
        turns = np.concatenate((turns, [len(inside)]))
    return turns[::2], turns[1::2]


def numbered(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words, equal for equal bytes, and the distinct words by number."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
