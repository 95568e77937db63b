"""Language identification with a string kernel.

A text is its set of character n-grams for n = 1 to ``SPECTRUM`` (a blended spectrum of presences). The kernel of two
texts is the share of n-grams they have in common: the size of the intersection over the root of the product of the
sizes. Landmark texts approximate its feature space (Nyström): z(x) = k(x, landmarks) K**(-1/2). One-versus-rest kernel
ridge regression on z gives a score for every language. Scoring is batches of matrix products: presences times landmark
presences, scaled, times the weights.

Fixed rule of symbols: white space, digits and all else that is no letter are one separator, runs of which count once;
letters of any script are lower-cased, and every one is a symbol of its own. N-grams are hashed into ``GRAMS`` places.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import mix64, small_batches, unused

SPECTRUM = 3
PLACE_BITS = 18
GRAMS = 1 << PLACE_BITS
UNKNOWN = "und"
#: At most about so many different texts of a language are learned from, chosen by a hash of text; so many of them are landmarks.
SAMPLE, LANDMARKS = 400, 40
RIDGE = 0.02
#: A text of a learned language has at least this share of the least evidence among the sample's texts.
LEVEL = 0.5
_TURN = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_LAST = np.uint32(0x27D4EB2F)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A number for every code point; 0 is the separator."""
    table = mix64(np.arange(1, 0x110001, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    table[[code for code in range(0x110000) if unicodedata.category(chr(code))[0] != "L"]] = 0
    return table


def grams(text: str) -> np.ndarray:
    """The sorted places of the n-grams of a whole text; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    sym = np.concatenate(([0], _symbols()[codes], [0])).astype(np.uint32)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    sym = sym[keep]
    if len(sym) < 2:
        return np.empty(0, np.int32)
    seen = np.zeros(GRAMS, bool)
    code = np.zeros(len(sym), np.uint32)
    for n in range(SPECTRUM):
        code = (code[: len(sym) - n] ^ (code[: len(sym) - n] >> np.uint32(15))) * _TURN[n] + sym[n:]
        seen[((code ^ (code >> np.uint32(13))) * _LAST) >> np.uint32(32 - PLACE_BITS)] = True
    seen[0] = False  # the separator alone
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class KernelModel:
    """What scoring needs: the n-grams of the landmarks, their presences, sizes, and the weights behind the kernel."""

    labels: list[str]
    index: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    level: float = 0.0  # the least evidence for a learned language

    def shared(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[text, landmark] numbers of common n-grams, and the texts' own numbers."""
        x = np.zeros((len(texts), self.presence.shape[1]), np.float32)
        for row, g in zip(x, texts, strict=True):
            at = self.index[g]
            row[at[at >= 0]] = 1
        return x @ self.presence.T, np.array([max(1, len(g)) for g in texts], np.float32)

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        both, own = self.shared(texts)
        return both / np.sqrt(own[:, None] * self.sizes[None, :])

    def evidence(self, both: np.ndarray, own: np.ndarray) -> np.ndarray:
        """[text, landmark] share of the smaller set that is common; whether a text is like a learned language does not depend on how many there are."""
        return both / np.minimum(own[:, None], self.sizes[None, :])

    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text a share per language (regression outputs cut to 0..1, by their sum), and the best evidence for any."""
        if not len(self.labels):
            return np.zeros((len(texts), 0)), np.zeros(len(texts))
        both, own = self.shared(texts)
        k = both / np.sqrt(own[:, None] * self.sizes[None, :])
        out = np.clip(np.hstack((k, np.ones((len(k), 1), np.float32))) @ self.weights, 1e-6, 1)
        return out / out.sum(1, keepdims=True), self.evidence(both, own).max(1)


def fit_kernel(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Fit on (language, n-grams) pairs. The first ``landmarks`` of each language are the landmarks."""
    samples = [(lang, g) for lang, g in samples if len(g)]
    labels = sorted({lang for lang, _ in samples})
    chosen = [g for lang in labels for g in [g for other, g in samples if other == lang][:landmarks]]
    index = np.full(GRAMS, -1, np.int32)
    used = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int32)
    index[used] = np.arange(len(used))
    presence = np.zeros((len(chosen), len(used)), np.float32)
    for row, g in zip(presence, chosen, strict=True):
        row[index[g]] = 1
    model = KernelModel(labels, index, presence, np.array([len(g) for g in chosen], np.float32), np.empty((0, 0), np.float32))
    if not labels:
        return model
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K**(-1/2) on its range
    z = np.vstack([model.kernel([g for _, g in samples[i : i + 256]]) for i in range(0, len(samples), 256)]).astype(np.float64) @ root
    y = np.array([[float(lang == x) for x in labels] for lang, _ in samples])
    share = y.mean(0)
    centre = z.mean(0)
    solved = np.linalg.solve((z - centre).T @ (z - centre) + ridge * len(z) / len(labels) * np.eye(z.shape[1]), (z - centre).T @ (y - share))
    model.weights = np.vstack((root @ solved, share - centre @ solved)).astype(np.float32)
    least = 1.0
    for i in range(0, len(samples), 256):
        part = [g for _, g in samples[i : i + 256]]
        e = model.evidence(*model.shared(part))
        for row, g in zip(e, part, strict=True):
            row[[j for j, other in enumerate(chosen) if other is g]] = 0  # a text is no evidence for itself
        least = min(least, float(e.max(1).min())) if len(chosen) > 1 else 0.0
    model.level = LEVEL * least
    return model


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> KernelModel:
    """Fit on a sample of at most about ``sample`` different texts of each language.

    Rows whose text or language is null are left out; copies of a text count once. The sample is drawn by a hash of the
    text, at a rate that follows from the number of different texts of each language over all rows. Copies fall together in
    map-side aggregates before anything is sent; workers turn texts into n-gram sets, so that a text of any length reaches
    the driver as at most ``GRAMS`` numbers.
    """
    given = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col)).alias("h")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not counts:
        return fit_kernel([])
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, sample / n)]), F.col("lang"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_batches(batches, "text"):
            yield pd.DataFrame({"lang": batch["lang"], "draw": batch["draw"], "grams": [grams(t).tobytes() for t in batch["text"]]})

    once = given.withColumn("draw", draw).where(F.col("draw") < rate).groupBy("lang", "draw", "h").agg(F.min("text").alias("text"))
    rows = once.mapInPandas(sets, "lang string, draw double, grams binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["grams"]))
    seen: dict[str, int] = {}
    kept = []
    for r in rows:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= 2 * sample:
            kept.append((r["lang"], np.frombuffer(r["grams"], np.int32)))
    return fit_kernel(kept)


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and evidence added (replacing columns of these names).

    ``und`` with score and evidence 0 if the text is null or has no letter, or if the model knows no language. Otherwise
    the language of the highest share, at a tie the first by name, with this share. evidence says how much of the text, or
    of a landmark, the two have in common at best; texts of no learned language stay below ``model.level``. Repeated rows
    each get theirs; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for whole in texts:
            found = []
            for batch in small_batches([whole.to_frame("text")], "text"):
                sets = [grams(t) if t else np.empty(0, np.int32) for t in batch["text"]]
                for g, s, e in zip(sets, *known.scores(sets), strict=True):
                    best = int(s.argmax()) if len(g) and len(s) else -1
                    found.append((known.labels[best], float(s[best]), float(e)) if best >= 0 else (UNKNOWN, 0.0, 0.0))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "evidence"]).astype({"lang_pred": object, "score": float, "evidence": float})

    classify = F.pandas_udf(run, "lang_pred string, score double, evidence double")
    (found,) = unused(docs, "found")
    added = docs.drop("lang_pred", "score", "evidence").withColumn(found, classify(F.col(text_col)))
    return added.withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score", "evidence")}).drop(found)
