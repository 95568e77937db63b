"""Vocabulary and typo correction by Damerau-Levenshtein distance.

Candidates come from equi-joins, so no query word is compared with the whole vocabulary. Short words within two edits,
transpositions included, share what remains of them after up to two deletions. Of long words, one is cut into two segments
for each edit and one more; an edit, transpositions included, touches two at most, so another one is left as it is, at most
as many places further as there are edits. Both give a number of keys that does not depend on the length of long words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions import columns as C
from mnemospark.functions import patterns as P
from mnemospark.operators.staging import materialise


def vocabulary(docs: DataFrame, text: Column, source: str) -> DataFrame:
    """term, frequency (documents), sources."""
    terms = docs.select(F.explode(C.vocabulary_terms(text)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("frequency")).withColumn("sources", F.array(F.lit(source)))


def session_vocabulary(sessions: DataFrame) -> DataFrame:
    """The vocabulary of sessions (keywords, summary, task_description): a term counts once a session and source."""
    keyword = vocabulary(sessions, F.array_join("keywords", " "), "keywords")
    return merge_vocabulary(merge_vocabulary(keyword, vocabulary(sessions, F.col("summary"), "summary")), vocabulary(sessions, F.col("task_description"), "task"))


def merge_vocabulary(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new)
    return both.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def distance(a: str, b: str) -> int:
    """Edits between two words, where a transposition may have edits within."""
    most = len(a) + len(b)
    rows = {(-1, -1): most}
    for i in range(len(a) + 1):
        rows[i, -1], rows[i, 0] = most, i
    for j in range(len(b) + 1):
        rows[-1, j], rows[0, j] = most, j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            up, left = seen.get(y, 0), last
            if x == y:
                last = j
            swap = rows[up - 1, left - 1] + i - up - 1 + 1 + j - left - 1 if up and left else most
            rows[i, j] = min(rows[i - 1, j - 1] + (x != y), rows[i, j - 1] + 1, rows[i - 1, j] + 1, swap)
        seen[x] = i
    return rows[len(a), len(b)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for many pairs at once: rows of ``a`` and of ``b`` are words as code points, all of one length on either side."""
    count, n, m = len(a), a.shape[1], b.shape[1]
    most, every = n + m, np.arange(count)
    rows = np.full((count, n + 2, m + 2), most, np.int32)
    rows[:, 1:, 1], rows[:, 1, 1:] = np.arange(n + 1), np.arange(m + 1)
    seen = np.zeros((count, m), np.int64)  # of each letter of b, the last row of a that has it
    for i in range(1, n + 1):
        last = np.zeros(count, np.int64)
        for j in range(1, m + 1):
            up, equal = seen[:, j - 1], a[:, i - 1] == b[:, j - 1]
            swap = np.where((up > 0) & (last > 0), rows[every, up, last] + i - up - 1 + 1 + j - last - 1, most)
            rows[:, i + 1, j + 1] = np.minimum(np.minimum(rows[:, i, j] + ~equal, np.minimum(rows[:, i + 1, j], rows[:, i, j + 1]) + 1), swap)
            last = np.where(equal, j, last)
        seen = np.where(b == a[:, i - 1 : i], i, seen)
    return rows[:, n + 1, m + 1]


def distance_within(a: str, b: str, most: int) -> int:
    """The same distance if it is ``most`` (0 to 2) at most, else ``most`` + 1; in time linear in the words.

    Equal letters at the front are matched, and at the first difference each edit is tried.
    """
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    if not a or not b or most == 0:
        return min(len(a) or len(b), most + 1)
    if abs(len(a) - len(b)) > most:
        return most + 1
    tries = [(1, 1, 1), (1, 0, 1), (0, 1, 1)]
    if a[0] == b[1:2] and a[1:2] == b[0]:
        tries.append((2, 2, 1))
    if most > 1:  # a transposition over a letter of one side
        if a[0] == b[1:2] and a[2:3] == b[0]:
            tries.append((3, 2, 2))
        if a[0] == b[2:3] and a[1:2] == b[0]:
            tries.append((2, 3, 2))
    best = most + 1
    for i, j, cost in tries:
        if cost < best:
            best = min(best, cost + distance_within(a[i:], b[j:], best - 1 - cost))
    return best


#: Longer words are compared by ``distance_within``.
LONG = 64


def edits(most: int):
    """A column function: edits between two words, or ``most`` + 1 for long words with more."""

    @F.pandas_udf(T.IntegerType())
    def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int32)
        codes = lambda words, size: np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)
        lengths = pd.DataFrame({"n": a.str.len().to_numpy(), "m": b.str.len().to_numpy()})
        for (n, m), rows in lengths.groupby(["n", "m"]).indices.items():
            for at in range(0, len(rows), 5000):
                some = rows[at : at + 5000]
                if max(n, m) > LONG:
                    out[some] = [distance_within(a.iloc[i], b.iloc[i], most) for i in some]
                else:
                    out[some] = distances(codes(a.iloc[some].tolist(), n), codes(b.iloc[some].tolist(), m))
        return pd.Series(out)

    return damerau_levenshtein


#: Words up to this length are met by what is left of them, longer ones by segments of two letters or more.
SHORT = 12
#: The keys of up to so many asked words (a hundred or so each) are broadcast, so that those of the vocabulary need no shuffle.
FEW = 10_000


def _remainders(word: Column) -> Column:
    """The word, and what is left after deleting one or two of its characters."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = without(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, without))))


def _segment(n: str, i: str, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a word of ``n`` letters; the last ones are longer by one."""
    base, more = f"{n} div {parts}", f"{parts} - {n} % {parts}"
    return F.expr(f"{i} * ({base}) + greatest(0, {i} - ({more}))"), F.expr(f"({base}) + if({i} >= {more}, 1, 0)")


def _pairs(asked: DataFrame, words: DataFrame, most: int, few: bool = False) -> DataFrame:
    """(term, word, frequency) of words that may be within ``most`` edits; with ``few`` asked ones."""
    sent = F.broadcast if few else lambda keys: keys
    left = asked.where(F.length("term") <= SHORT + most).select("term", F.explode(_remainders(F.col("term"))).alias("key"))
    right = words.where(F.length("term") <= SHORT + most).select(F.col("term").alias("word"), "frequency", F.explode(_remainders(F.col("term"))).alias("key"))
    short = right.join(sent(left), "key").select("term", "word", "frequency")

    parts, shifts = 2 * most + 1, 2 * most + 1
    start, size = _segment("n", "i", parts)
    key = lambda word, at: F.xxhash64(F.col("n").cast("int"), F.col("i").cast("int"), F.substring(F.col(word), (at + 1).cast("int"), size.cast("int"))).alias("key")
    cut = words.where(F.length("term") > SHORT).select(F.col("term").alias("word"), "frequency", F.length("term").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"))
    cut = cut.select("word", "frequency", key("word", start))
    tried = asked.where(F.length("term") > SHORT).select("term", F.explode(F.sequence(F.lit(0), F.lit(shifts * shifts * parts - 1))).alias("c"))
    tried = tried.select("term", F.expr(f"length(term) + c div {shifts * parts} - {most}").alias("n"), F.expr(f"c div {shifts} % {parts}").alias("i"), F.expr(f"c % {shifts} - {most}").alias("d"))
    place = start + F.col("d")
    tried = tried.where((F.col("n") > SHORT) & (place >= 0) & (place + size <= F.length("term"))).select("term", key("term", place)).distinct()
    return short.union(cut.join(sent(tried), "key").select("term", "word", "frequency"))


def closest(terms: DataFrame, words: DataFrame, most: int = P.FUZZY_MOST_EDITS) -> DataFrame:
    """term, correction, edits: for terms not in ``words`` (term, frequency) the nearest word, the more frequent at a tie, then the first.

    Terms that are short, stopwords or numbers have no correction.
    """
    asked = terms.select("term").distinct().where((F.length("term") >= P.FUZZY_LEAST_LENGTH) & ~F.col("term").isin(P.FUZZY_STOPWORDS) & ~F.regexp_like("term", F.lit(r"^\d+$")))
    words = materialise(words.select("term", "frequency"), "words")  # read by several joins
    asked = materialise(asked.join(words.select("term"), "term", "left_anti"), "asked")
    lengths = asked.agg((F.min(F.length("term")) - most).alias("shortest"), (F.max(F.length("term")) + most).alias("longest"))
    words = words.crossJoin(F.broadcast(lengths)).where(F.length("term").between(F.col("shortest"), F.col("longest")))  # lengths is one row
    near = _pairs(asked, words, most, asked.count() <= FEW).where((F.abs(F.length("term") - F.length("word")) <= most) & (F.levenshtein("term", "word", 2 * most) >= 0)).distinct()
    near = near.withColumn("edits", edits(most)("term", "word")).where(F.col("edits") <= most)
    best = F.min(F.struct("edits", (-F.col("frequency")).alias("f"), "word"))
    return near.groupBy("term").agg(best.alias("b")).select("term", F.col("b.word").alias("correction"), F.col("b.edits").alias("edits"))


def corrected_queries(queries: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """Queries with their terms corrected, and how many were."""
    parts = queries.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w+\b"), F.lit(0))).alias("place", "term"))
    fixed = parts.join(closest(parts, words), "term", "left")
    word = F.coalesce("correction", "term")
    out = fixed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", word.alias("word")))).alias("w"), F.count("correction").alias("corrections"))
    return out.select(key, F.array_join(F.col("w.word"), " ").alias("query"), "corrections")
