"""Quality rules on repetition within a text, by suffix arrays over its words.

The suffixes of a text's words are sorted by prefix doubling, all texts of a batch at once; only suffixes that still agree
with a neighbour take part in the next round. Intervals of the longest-common-prefix array are the repeated substrings;
those that no word to the left extends are the maximal ones. The union of their spans is what a text says again. It may
hold a limited share of the characters in words, and no repeat may be longer than a limit. A text is judged by itself, in
the task that reads it: nothing is shuffled, and a task holds a few megabytes of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_slices
from mnemospark.llm.words import BLANK, joined, numbered, runs

#: A repeat counts from so many words on; the share of characters that repeats may cover, in percent; words of the longest.
LEAST_REPEAT, MOST_COVERED, MOST_REPEAT = 10, 30, 100
LEAST_WORDS, MOST_REPEAT_WORDS = 50, 50
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_chars long, longest_repeat long, "
    "n_repeats long, spans array<long>, kept boolean"
)


def suffix_order(text: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of all texts in order; ``text`` numbers the text of each word, ``ends`` is where that text ends."""
    n = len(words)
    first = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    new = np.concatenate(([True], first[order[1:]] != first[order[:-1]])) if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    active, step = order[~alone], 1
    while len(active):
        after = active + step
        key = rank[active] * (n + 1) + np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]  # the place of its group's first
        change = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
        at = np.arange(len(active))
        places = group + at - np.maximum.accumulate(np.where(change(group), at, 0))
        new = change(key)
        order[places] = active
        rank[active] = np.maximum.accumulate(np.where(new, places, 0))
        active = active[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def common_prefixes(order: np.ndarray, words: np.ndarray, ends: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in order, if they are ``least`` or more, or else as many as were compared."""
    n = len(order)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
    for depth in range(least):
        a, b = order[at - 1] + depth, order[at] + depth
        at = at[(a < ends[order[at - 1]]) & (b < ends[order[at]])]
        a, b = order[at - 1] + depth, order[at] + depth
        at = at[words[a] == words[b]]
        out[at] = depth + 1
    if not len(at):
        return out
    # a suffix shares at most one word less than the suffix that begins one word earlier
    place = np.sort(order[at])
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before, stop, word = order[slot[place] - 1].tolist(), ends[place].tolist(), words.tolist()
    shared, last, found = 0, -2, []
    for i, j, end in zip(place.tolist(), before, stop, strict=True):
        shared = max(least, shared - 1) if i == last + 1 else least
        while i + shared < end and j + shared < end and word[i + shared] == word[j + shared]:
            shared += 1
        found.append(shared)
        last = i
    out[slot[place]] = found
    return out


def maximal_repeats(order: np.ndarray, common: np.ndarray, words: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """[interval, (first, last, words)]: LCP intervals of at least ``least`` words that no one word to the left extends."""
    out, stack = [], []
    last = -2
    for j in [*np.flatnonzero(common >= least).tolist(), -1]:
        height = int(common[j]) if j >= 0 else 0
        if j != last + 1:
            while stack:
                low, top = stack.pop()
                out.append((low, last, top))
        low = j - 1
        while stack and stack[-1][1] > height:
            low, top = stack.pop()
            out.append((low, j - 1, top))
        if height and (not stack or stack[-1][1] < height):
            stack.append((low, height))
        last = j
    found = np.array(out, np.int64).reshape(-1, 3)
    left = np.where((order > 0) & (text[order - 1] == text[order]), words[order - 1], -1 - order)
    differs = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    return found[differs[found[:, 1]] > differs[found[:, 0]]]


def measured(texts: list[bytes | None], least: int = LEAST_REPEAT) -> dict[str, np.ndarray | list]:
    """What the rules look at, for each text."""
    data, begins = joined(texts)
    count = len(texts)
    inside = ~BLANK[data]
    starts, stops = runs(inside)
    text = np.searchsorted(begins, starts, "right") - 1
    words, _ = numbered(data, inside, starts, stops)
    tail = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that go on with a character
    chars = stops - starts - np.searchsorted(tail, stops) + np.searchsorted(tail, starts)
    add = lambda where, values=None: np.bincount(where, values, count).astype(np.int64)
    ends = np.cumsum(np.bincount(text, minlength=count))[text]

    order = suffix_order(text, words, ends)
    common = common_prefixes(order, words, ends, text, max(3, least))
    longest = np.maximum(common, np.append(common[1:], 0))  # of each suffix, the deepest interval that holds it
    repeat = np.empty(len(order), np.int64)
    repeat[order] = longest
    reach = lambda length, width: np.maximum.accumulate(np.where(length >= width, np.arange(len(length)) + (width if width == 3 else length), 0)) > np.arange(len(length))
    three, covered = reach(repeat, 3), reach(repeat, least)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, text, np.where(repeat >= least, repeat, 0))
    found = maximal_repeats(order, common, words, text, least)

    # runs of covered words, parted where a text ends
    span_from, span_to = [], []
    edge = np.flatnonzero(covered & ~np.concatenate(([False], covered[:-1] & (text[1:] == text[:-1]))))
    close = np.flatnonzero(covered & ~np.concatenate((covered[1:] & (text[1:] == text[:-1]), [False])))
    if len(edge):
        span_from, span_to = starts[edge] - begins[text[edge]], stops[close] - begins[text[edge]]
    spans: list[list[int]] = [[] for _ in texts]
    for t, a, b in zip(text[edge].tolist(), np.asarray(span_from).tolist(), np.asarray(span_to).tolist(), strict=True):
        spans[t] += (a, b)

    again = []
    for t in texts:
        seen, n = set(), 0
        for line in (t or b"").split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip():
                seen.add(line)
        again.append(n)
    return {
        "n_words": add(text), "word_chars": add(text, chars), "n_symbols": add(np.searchsorted(begins, np.flatnonzero(SYMBOL[data]), "right") - 1), "n_dup_lines": np.array(again, np.int64),
        "n_repeat_words": add(text[three]), "covered_chars": add(text[covered], chars[covered]), "longest_repeat": most, "n_repeats": add(text[order[found[:, 0]]]), "spans": spans,
    }


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_repeat: int = LEAST_REPEAT, most_covered: int = MOST_COVERED, most_repeat: int = MOST_REPEAT, least_words: int = LEAST_WORDS,
    most_repeat_words: int = MOST_REPEAT_WORDS,
) -> DataFrame:
    """One row per input row: its measures, the spans that repeats cover (start and end bytes in turn), and whether it is kept.

    A text goes if it has fewer than ``least_words`` words, if windows of three words that come twice hold more than
    ``most_repeat_words`` percent of them, if repeats of at least ``least_repeat`` words cover more than ``most_covered``
    percent of the characters in words, or if one is longer than ``most_repeat`` words. Null is an empty text, which has no
    words and goes. Repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    if least_repeat < 3:
        raise ValueError("a repeat has three words at least")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches, "bytes"):
            m = measured(part.column("bytes").to_pylist(), least_repeat)
            failed = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeat_words * m["n_words"])
            kept = ~failed & (100 * m["covered_chars"] <= most_covered * m["word_chars"]) & (m["longest_repeat"] <= most_repeat)
            values = {"doc_id": part.column("doc_id"), **{k: pa.array(v, pa.list_(pa.int64())) if k == "spans" else pa.array(v) for k, v in m.items()}, "base_failed": pa.array(failed), "kept": pa.array(kept)}
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([values[n] for n in names], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes")).mapInArrow(judge, RESULT)
