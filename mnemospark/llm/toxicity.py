"""Toxicity by a counterfactually regularised classifier.

A text is the set of its words and of their beginnings, hashed into ``FEATURES`` places. A logistic regression is
fitted to labelled texts; for each labelled text that names a group of people, copies with the identity terms swapped for
others of their kind are made, and the squared change of the score from swap to swap is penalised with the loss. So the
weight of an identity term cannot carry what its neighbours in the sample say, and neutral mentions stay low.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import small_batches

FEATURES = 1 << 20
#: The classifier is fitted to at most about so many labelled texts of each class, chosen by a hash of the id.
SAMPLE = 6000
#: The sample ends where its texts and their swapped copies have so many features in all.
PLACES = 8_000_000
STEMS = (4, 5, 6)
SWAPS = 3
LEAST_TEXTS = 4
LEAST_HELD = 30
FOLDS = 4
#: Identity terms by kind; a term is swapped for another of its line.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "queer"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["deaf", "blind", "disabled", "elderly", "young"],
]
_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(tokens: list[str]) -> np.ndarray:
    """Sorted places of the words of a text and of their first ``STEMS`` letters, which inflected forms share."""
    whole = set(tokens)
    seen = {zlib.crc32(w.encode()) for w in whole}
    for n in STEMS:
        seen.update([zlib.crc32(w.encode(), n) for w in {w[:n] for w in whole if len(w) > n}])
    return np.unique(np.fromiter(seen, np.int64, len(seen)) % FEATURES)


def swapped(tokens: list[str], swaps: int = SWAPS) -> list[list[str]]:
    """Copies of a text with every identity term moved on by 1, 2, ... within its kind; none without such a term."""
    if not any(t in _KIND for t in tokens):
        return []
    return [[_KIND[t][(_KIND[t].index(t) + by) % len(_KIND[t])] if t in _KIND else t for t in tokens] for by in range(1, swaps + 1)]


def _rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def fit(texts: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], fairness: float = 1.0, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights of all places, the bias last. ``swaps``: (number of the text, features of a swapped copy)."""
    weights = np.zeros(FEATURES + 1)
    if not len(labels):
        return weights
    if labels.min() == labels.max():
        weights[-1] = 6.0 if labels[0] else -6.0
        return weights
    places, row = _rows(texts)
    common = np.bincount(places, minlength=FEATURES) >= min(LEAST_TEXTS, len(texts))
    for _, s in swaps:
        common[s] = True
    columns = np.flatnonzero(common)
    to = np.full(FEATURES, -1)
    to[columns] = np.arange(len(columns))
    keep = to[places] >= 0
    places, row = to[places[keep]].astype(np.int32), row[keep].astype(np.int32)
    swap_places, swap_row = _rows([to[s] for _, s in swaps])
    parent = np.array([i for i, _ in swaps], int)
    n, m = len(labels), max(1, len(swaps))
    balance = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    w, b = np.zeros(len(columns)), 0.0
    mean, square = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[places], n) + b
        error = balance * (1 / (1 + np.exp(-z)) - labels) / n
        if len(swaps):
            change = z[parent] - b - np.bincount(swap_row, w[swap_places], len(swaps))
            pull = fairness * change / m
            error_w = error + np.bincount(parent, pull, n)
            slope = np.bincount(places, error_w[row], len(w)) - np.bincount(swap_places, pull[swap_row], len(w))
        else:
            slope = np.bincount(places, error[row], len(w))
        slope = np.append(slope + ridge * w, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights[columns] = w
    weights[-1] = b
    return weights


def threshold(scores: np.ndarray, labels: np.ndarray, rates: tuple[float, float] = (1.0, 1.0)) -> float:
    """The middle of the range of thresholds with the fewest errors, given at which rates negative and positive texts were drawn."""
    order = np.argsort(scores, kind="stable")
    scores, labels = scores[order], labels[order]
    errors = np.concatenate(([0.0], np.cumsum(labels) / rates[1] - np.cumsum(1 - labels) / rates[0]))
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate(([scores[0] - 1], scores, [scores[-1] + 1]))
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, places: int = PLACES) -> np.ndarray:
    """Fit on at most about ``sample`` texts of each class. ``labels``: id and label; null labels and texts are left out.

    The threshold is set by the scores that texts get from models fitted without them, a ``FOLDS``-th of each class at a
    time, as far as there are ``LEAST_HELD`` texts of each. An id with several labels counts as toxic if one of them says
    so. A model is fitted in one task, of which there is one more than folds: the sample is bounded by ``sample`` texts,
    and by ``places`` features, up to which texts are taken in the order of a hash. The driver gets weights and scores only.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    counts = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    rates = tuple(min(1.0, sample / max(1, counts.get(k, 0))) for k in (0, 1))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(F.col("_label").isin(0, 1) & (draw < F.when(F.col("_label") == 1, rates[1]).otherwise(rates[0])))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).where("text is not null")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = lambda x: x.astype(np.int32).tobytes()
        for batch in small_batches(batches, "text"):
            tokens = [words(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["_label"], "places": [pack(features(t)) for t in tokens], "swaps": [[pack(features(s)) for s in swapped(t)] for t in tokens]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, fold = [], None
        for b in batches:
            for k, label, p, s in b[["k", "label", "places", "swaps"]].itertuples(index=False, name=None):
                fold = int(k)
                rows.append((zlib.crc32(p), p, int(label), list(s)))
        if fold is None:
            return
        rows.sort()
        size = np.cumsum([len(p) // 4 + sum(len(x) for x in s) // 4 for _, p, _, s in rows])
        rows = sorted(rows[: int(np.searchsorted(size, places, "right"))], key=lambda r: r[2])
        unpack = lambda x: np.frombuffer(x, np.int32)
        texts, labels = [unpack(p) for _, p, _, _ in rows], np.array([r[2] for r in rows], float)
        out = np.arange(len(rows)) % FOLDS == fold
        used = np.flatnonzero(~out)
        weights = fit([texts[i] for i in used], labels[used], [(j, unpack(x)) for j, i in enumerate(used) for x in rows[i][3]])
        held = [float(weights[texts[i]].sum() + weights[-1]) for i in np.flatnonzero(out)]
        yield pd.DataFrame({"k": [fold], "labels": [labels[out]], "scores": [np.array(held)], "weights": [weights.astype(np.float32).tobytes() if fold == FOLDS else b""]})

    # the sample is bounded by its parameter, so it may be broadcast, and each fold may hold all of it
    found = texts.join(F.broadcast(chosen), "_id").mapInPandas(sets, "label int, places binary, swaps array<binary>")
    dealt = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionById(FOLDS + 1, F.col("k"))
    out = {r["k"]: r for r in dealt.mapInPandas(fitted, "k int, labels array<double>, scores array<double>, weights binary").collect()}
    if not out:
        return np.zeros(FEATURES + 1)
    weights = np.frombuffer(out[FOLDS]["weights"], np.float32).astype(np.float64)
    held, scores = (np.array([x for k in range(FOLDS) for x in out[k][c]]) for c in ("labels", "scores"))
    if min((held == k).sum() for k in (0, 1)) >= LEAST_HELD:
        weights[-1] -= threshold(scores, held, rates)
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on) added, replacing columns of these names.

    Null and empty texts have the score of a text without words. Repeated rows each get theirs; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for whole in texts:
            out = []
            for batch in small_batches([whole.to_frame("text")], "text"):
                for t in batch["text"]:
                    z = float(known[-1]) + (float(known[features(words(t))].sum(dtype=np.float64)) if t else 0.0)
                    out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
            yield pd.Series(out, dtype=float)

    scored = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(run, "double")(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
