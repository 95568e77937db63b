"""Log-probabilities of texts under a log-bilinear model trained with noise-contrastive estimation.

The model predicts the symbol of the next token from its two predecessors. Every word from a least count on is a symbol of its
own, all rarer ones share symbols by a hash of the word, the end of a text is another. Both least count and number of
symbols follow from the corpus. The prediction is the sum of the predecessors' vectors, each through the matrix of its
position; its products with vectors plus biases are scores, first of the groups of symbols (runs of neighbours by frequency,
about the square root of their number), then of the symbols inside the group, both normalised. A word of a shared symbol has
the symbol's probability times its share in it by additively smoothed counts.

Spark counts the words of all training texts, then turns every text into symbols once. Tasks train on partitions of the
symbols of the training texts from common vectors, in an order drawn anew, so that every token of every training text is learned
from at least once; after each round the vectors are averaged by blocks. Tasks grow in number with the root of the tokens, so that what they send back stays small beside the
corpus. Words with symbols of their own, at least ``HEAD``, are broadcast with their counts; the other words of a text are
looked up by a join on the word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import discard, fold, materialise, small_slices
from mnemospark.operators.staging import shuffles_removed

HEAD = 1 << 18
#: Words of at least this count, and of at least the root of the tokens over ``FINE``, are symbols of their own.
LEAST, FINE = 3, 16
#: Rarer words share symbols by a hash, one for so many words with symbols of their own; a hash says nothing of a word, so few do.
SHARED = 16
WIDTH, NOISE, INNER, STEPS, BATCH = 32, 12, 5, 5000, 1024
#: All tokens are visited once, or more often where that is fewer than ``STEPS`` batches; vectors are averaged after each of so many rounds.
ROUNDS = 4
#: Draws of noise among the groups and inside each, shared by the tokens of a batch; so many batches follow before they are drawn anew.
DRAWN, KEPT = 128, 8
#: A group of at most one in so many of the tokens of those batches is met by one of them only.
RARE = 16
#: A worker counts words of so many bytes before it hands them on; it trains on so many tokens at a time.
COUNTED, HELD = 64_000_000, 1_000_000
#: As many tasks train as the root of the tokens over this.
PART = 500_000
#: Floats of a block of the vectors.
BLOCK = 32_768


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of UTF-8 texts between ASCII white space, A to Z in lower case, as binary, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))  # works on bytes, whatever they encode
    found = parts.flatten().view(pa.binary())
    full = pc.greater(pc.binary_length(found), 0)  # white space at an end of a text has an empty part beyond it
    owner = pc.list_parent_indices(parts).filter(full).to_numpy(zero_copy_only=False)
    return found.filter(full), np.bincount(owner, minlength=len(texts))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        seen = pa.concat_arrays(held).value_counts()
        return pa.RecordBatch.from_arrays(seen.flatten(), names=["word", "n"])

    held, size = [], 0
    for batch in small_slices(batches, "text"):
        found = words(batch.column("text"))[0]
        if held and size + found.nbytes > COUNTED:
            yield made()
            held, size = [], 0
        held.append(found)
        size += found.nbytes
    if held:
        yield made()


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different row numbers, and the sum of the values of each: an even number of single-precision columns, added up two by two as complex numbers, which is faster."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.add.reduceat(np.take(values, order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


def deal(at: np.ndarray, batch: int, groups: int, rng: np.random.Generator) -> np.ndarray:
    """An order of a window's tokens, which stand in the groups ``at``, for batches of ``batch``.

    Tokens of a rare group follow one another, so that few batches meet its targets; those of others are spread over the window
    by chance.
    """
    count = np.bincount(at, minlength=groups)
    batches = len(at) // batch
    common = count[at] * RARE > len(at)
    of = np.arange(groups) % max(1, batches)
    rare = np.flatnonzero(~common)
    rare = rare[np.argsort(of[at[rare]], kind="stable")]
    room = np.maximum(batch - np.bincount(of[at[rare]], minlength=batches), 0)
    to = rng.permutation(np.resize(np.repeat(np.arange(batches), room), int(common.sum())))
    every = np.concatenate((rare, np.flatnonzero(common)))
    return every[np.argsort(np.concatenate((of[at[rare]], to)), kind="stable")]


class Bilinear:
    """Vectors of ``len(frequency) + 1`` symbols as predecessors and of all but the last as targets, and how to train them.

    Groups and targets have their biases behind their vectors, as what is learned beyond the logarithm of the noise's rate.
    """

    def __init__(self, frequency: np.ndarray, width: int = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        targets = len(frequency)
        self.n, self.size = targets + 1, math.isqrt(targets - 1) + 1
        share = (frequency + 0.5) / (frequency + 0.5).sum()
        self.starts = np.arange(0, targets, self.size)
        group = np.add.reduceat(share, self.starts)
        inner = share / group[np.arange(targets) // self.size]
        self.groups, self.up = np.cumsum(group), np.concatenate(([0.0], np.cumsum(share)))
        f4 = lambda x: np.asarray(x, np.float32)
        self.log_group, self.log_inner = f4(np.log(NOISE * group)), f4(np.log(INNER * inner))
        vectors = lambda k, rate: np.hstack((f4(rng.normal(0, 0.1, (k, width))), np.full((k, 1), -math.log(rate), np.float32)))
        self.r, self.q = f4(rng.normal(0, 0.1, (self.n, width))), np.zeros((len(group) * self.size, width + 1), np.float32)
        self.q[:targets] = vectors(targets, INNER)
        self.c, self.g = f4(np.stack([np.eye(width) * 0.5, np.eye(width)])), vectors(len(group), NOISE)
        # sums of squared gradients: one a row of r and q
        self.sr, self.sq, self.sb = (np.full(k, 1e-2, np.float32) for k in (self.n, len(self.q), len(self.q)))
        self.sc, self.sg = (np.full_like(x, 1e-2) for x in (self.c, self.g))

    def _arrays(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.g, self.sr, self.sc, self.sq, self.sg, self.sb]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._arrays()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in self._arrays():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def noise(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """How often noise names each group, and each target inside its group, for every token: shares of ``DRAWN`` draws of each."""
        of_group = np.bincount(np.minimum(np.searchsorted(self.groups, rng.random(DRAWN)), len(self.g) - 1), minlength=len(self.g))
        low, high = self.starts, np.minimum(self.starts + self.size, self.n - 1)
        base = self.up[low][:, None]
        drawn = np.searchsorted(self.up, base + rng.random((len(low), DRAWN)) * (self.up[high][:, None] - base), "right") - 1
        of_word = np.bincount(np.clip(drawn, low[:, None], high[:, None] - 1).ravel(), minlength=len(self.q))
        return (of_group * (NOISE / DRAWN)).astype(np.float32), (of_word * (INNER / DRAWN)).astype(np.float32).reshape(-1, self.size)

    def descend(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, steps: int, rate: Callable[[float], float], rng: np.random.Generator, batch: int = BATCH, order: np.ndarray | None = None) -> None:
        """Noise-contrastive steps on the tokens w, each after u and v, in an order that is repeated as needed, or else on draws.

        The tokens of a batch share their noise. They stand by group, so that those of one meet its targets in one product, and
        the group's own vector with them, as a target behind the others; other groups are only met where noise names them.
        """
        order = rng.integers(0, len(w), steps * batch) if order is None else np.resize(order, steps * batch)
        (r, c, g), (before, last, now) = (self.r, self.c.reshape(-1, self.c.shape[2]), self.g), (u, v, w)
        groups, size, width = len(g), self.size, r.shape[1]
        narrow = np.uint16 if self.n < 1 << 16 else np.int64  # short numbers are sorted by their digits
        q = np.zeros((groups, width + 1, size + 1), np.float32)  # targets in columns, so that sums over a vector run along rows
        q[:, :, :-1] = self.q.reshape(groups, size, -1).transpose(0, 2, 1)
        sq, sb = np.ones((groups, size + 1), np.float32), np.ones((groups, size + 1), np.float32)
        sq[:, :-1], sb[:, :-1] = self.sq.reshape(groups, size), self.sb.reshape(groups, size)
        sums, rates = np.empty_like(q), np.zeros((groups, size + 1), np.float32)
        across, back, into = list(q), [x[:-1].T for x in q], list(sums)
        h, near, every = np.ones((batch, width + 1), np.float32), np.empty((batch, size + 1), np.float32), np.arange(batch)
        gh, more = np.empty((2, batch, width), np.float32)
        for step in range(steps):
            eta = np.float32(rate(step / steps))
            if step % KEPT == 0:
                of_group, rates[:, :-1] = self.noise(rng)
                named = np.flatnonzero(of_group)
                of_group = of_group[named]
                window = order[step * batch : (step + KEPT) * batch]
                window = window[deal(np.take(now, window) // size, batch, groups, rng)]
            drawn = window[step % KEPT * batch :][:batch]
            at = np.take(now, drawn) // size
            by = np.argsort(at.astype(narrow), kind="stable")
            at, drawn = at[by], drawn[by]
            w, pair = np.take(now, drawn), np.stack((np.take(before, drawn), np.take(last, drawn)), 1)
            known = np.take(r, pair, axis=0).reshape(batch, -1)
            np.matmul(known, c, out=h[:, :-1])
            q[:, :, -1] = g
            some = g[named]
            error = self._sigmoid(h @ some.T)
            error *= of_group
            np.matmul(error, some[:, :-1], out=gh)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch]
            seen = at[cuts[:-1]]
            runs = [(k, h[x:y], near[x:y], more[x:y]) for k, x, y in zip(seen.tolist(), cuts, cuts[1:], strict=False)]
            for k, mine, score, _ in runs:
                np.dot(mine, across[k], out=score)
            self._sigmoid(near)
            place = w - at * size
            own, of = near[every, place] - 1, near[:, -1] - 1
            near *= np.take(rates, at, axis=0)
            near[every, place] += own
            near[:, -1] = of
            for (k, mine, wrong, out), gradient in zip(runs, into, strict=False):
                np.dot(wrong, back[k], out=out)
                np.dot(mine.T, wrong, out=gradient)
            gh += more
            gc = known.T @ gh
            gg, theirs = np.zeros_like(g), sums[: len(runs)]
            gg[seen] = theirs[:, :, -1]
            gg[named] += error.T @ h
            vectors, biases = theirs[:, :-1], theirs[:, -1]
            sq[seen] += np.einsum("kij,kij->kj", vectors, vectors) / np.float32(width)
            sb[seen] += biases * biases
            biases *= eta / np.sqrt(sb[seen])
            vectors *= (eta / np.sqrt(sq[seen]))[:, None]
            q[seen] -= theirs
            to, grad = _sums(pair.ravel().astype(narrow), (gh @ c.T).reshape(2 * batch, -1))
            self.sr[to] += np.einsum("ij,ij->i", grad, grad) / np.float32(width)
            grad *= (eta / np.sqrt(self.sr[to]))[:, None]
            r[to] -= grad
            for x, grad, s, slow in ((self.c, gc.reshape(self.c.shape), self.sc, 0.2), (g, gg, self.sg, 1)):
                s += grad * grad
                x -= np.float32(slow) * eta * grad / np.sqrt(s)
        self.q[...] = q[:, :, :-1].transpose(0, 2, 1).reshape(self.q.shape)
        self.sq[...], self.sb[...] = sq[:, :-1].ravel(), sb[:, :-1].ravel()

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        """1 / (1 + exp(-x)), in its place."""
        np.negative(x, out=x)
        with np.errstate(over="ignore"):  # the reciprocal of infinity is the zero it should be
            np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)

    def table(self) -> Table:
        g, q = self.g, self.q[: self.n - 1]
        return Table(self.n, self.size, self.r @ self.c[0], self.r @ self.c[1], g[:, :-1], g[:, -1] + self.log_group, q[:, :-1], q[:, -1] + self.log_inner)


#: Tokens that are scored at a time, few enough for a processor's cache.
ROWS = 2048
#: Scores up to this have exponentials that add up in single precision without a shift.
SAFE = 60.0


@dataclass
class Table:
    """A trained model for scoring: predecessors' vectors through their matrices, groups and symbols, each with a bias behind."""

    n: int
    size: int
    first: np.ndarray
    second: np.ndarray
    g: np.ndarray
    bg: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def __post_init__(self):
        one, zero = np.ones((len(self.first), 1), self.first.dtype), np.zeros((len(self.first), 1), self.first.dtype)
        self.left, self.right = np.hstack((self.first, one)), np.hstack((self.second, zero))
        self.groups, self.words = np.hstack((self.g, self.bg[:, None])).T.copy(), np.hstack((self.q, self.b[:, None]))
        norm = lambda x: float(np.sqrt((np.float64(x) ** 2).sum(1)).max()) if len(x) else 0.0
        self.longest = max(norm(self.groups.T), norm(self.words))

    def _chosen(self, h: np.ndarray, vectors: np.ndarray, at: np.ndarray, shift: bool) -> np.ndarray:
        """Normalised natural log-probability, in each row of h, of the column of ``vectors`` that ``at`` names."""
        scores = h @ vectors
        if shift:
            scores -= scores.max(1, keepdims=True)
        own = scores[np.arange(len(h)), at]
        return own - np.log(np.exp(scores, out=scores) @ np.ones(vectors.shape[1], h.dtype))

    def logs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural log-probability of each w after u and v, over all symbols: its group's, and its own inside the group."""
        at = w // self.size
        order = np.argsort(at.astype(np.uint16) if len(self.g) < 1 << 16 else at, kind="stable")
        out = np.empty(len(w))
        for i in range(0, len(w), ROWS):
            rows = order[i : i + ROWS]
            group = at[rows]
            h = np.take(self.left, np.take(u, rows), axis=0)
            h += np.take(self.right, np.take(v, rows), axis=0)
            shift = math.sqrt(np.einsum("ij,ij->i", h, h).max()) * self.longest > SAFE  # no score is beyond the product of lengths
            found = self._chosen(h, self.groups, group, shift).astype(np.float64)
            cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(rows)]
            for x, y in zip(cut, cut[1:], strict=False):
                low = int(group[x]) * self.size
                found[x:y] += self._chosen(h[x:y], self.words[low : low + self.size].T, w[rows[x:y]] - low, shift)
            out[rows] = found
        return out


def _rate(progress: float) -> float:
    return 0.15 * (1 - progress) + 0.005


def visits(n: int, total: int, turn: int, seed: list[int]) -> np.ndarray:
    """The places a round visits of ``n``: over all rounds at least ``total`` visits, as equal in number as can be, at least one each.

    Shuffled runs of all places follow one another, and rounds cut them; short ones are shuffled several at a time.
    """
    total = max(n, total)
    run = np.tile(np.arange(n), max(1, min(4 * BATCH // n, total // n)))
    a, b = total * turn // ROUNDS, total * (turn + 1) // ROUNDS
    parts = [np.random.default_rng([*seed, k]).permutation(run)[max(a - k * len(run), 0) : b - k * len(run)] for k in range(a // len(run), -(-b // len(run)))]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def train(symbols: np.ndarray, n: int, width: int = WIDTH, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> np.ndarray:
    """Normalised natural log-probabilities, [pair of predecessors, target], of a small model of one run of ``n`` symbols; the last is never predicted."""
    model = Bilinear(np.bincount(symbols[2:], minlength=n - 1).astype(np.float64), width, seed)
    if len(symbols) > 2:
        model.descend(symbols[:-2], symbols[1:-1], symbols[2:], steps, _rate, np.random.default_rng(seed), batch)
    t = model.table()
    t = Table(t.n, t.size, *(x.astype(np.float64) for x in (t.first, t.second, t.g, t.bg, t.q, t.b)))
    pair, w = np.divmod(np.arange(n * n * (n - 1)), n - 1)
    return t.logs(pair // n, pair % n, w).reshape(n * n, n - 1)


@dataclass
class Lexicon:
    """What turning texts into symbols broadcasts: the head words with their counts, and the numbers of symbols."""

    head: dict[bytes, int]  # a word's number, by falling count; the first ``own`` are symbols
    counts: np.ndarray
    own: int
    shared: int
    mass: np.ndarray  # smoothed counts of the shared symbols
    frequency: np.ndarray  # of all symbols that are predicted: own words, shared ones, the end
    total: int  # tokens learned from
    types: int
    ends: int

    @property
    def start(self) -> int:
        """The symbol before a text, the last one; the one before it ends a text."""
        return self.own + self.shared + 1

    def by_hash(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.own + crc32(w) % self.shared for w in words), np.int64, len(words))


def lexicon(docs: DataFrame, text_col: str = "text", head: int = HEAD) -> tuple[Lexicon, DataFrame]:
    """Counts of the words of all rows of ``docs``, and the table (word, n) of those beyond the head."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    vocabulary = materialise(texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    ends = texts.count()
    types, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, types = int(total) + ends, int(types) + (ends > 0)
    least = max(LEAST, math.ceil(math.sqrt(total) / FINE))
    while (own := vocabulary.where(F.col("n") >= least).count()) >= 1 << 20:
        least *= 2  # a bound on what is broadcast
    shared = max(16, own // SHARED)
    head = max(head, own)
    # the head is looked for among words of about its frequency and above, so that few more than it reach the driver
    scale = F.floor(16 * F.log2("n")).cast("int")
    above, lowest = 0, None
    for r in vocabulary.groupBy(scale.alias("scale")).agg(F.count("*").alias("words")).orderBy(F.desc("scale")).collect():
        if above >= head:
            break
        above, lowest = above + r["words"], r["scale"]
    first = vocabulary.where(scale >= (lowest or 0)).orderBy(F.desc("n"), "word").limit(head).toArrow()
    counts = first.column("n").to_numpy().astype(np.int64)
    rare, mass = np.zeros(shared), np.full(shared, 0.5)  # half a count is for unknown words
    for r in vocabulary.where(F.col("n") < least).groupBy((F.crc32("word") % shared).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        rare[r["k"]] = r["n"]
        mass[r["k"]] += r["n"] + 0.5 * r["words"]
    frequency = np.concatenate((counts[:own], rare, [ends])).astype(np.float64)
    known = Lexicon({w: i for i, w in enumerate(first.column("word").to_pylist())}, counts, own, shared, mass, frequency, total, types, ends)
    tail = vocabulary.where(F.col("n") <= (int(counts[-1]) if len(counts) == head else -1))  # ties with the head's last do no harm
    return known, tail


ENCODED = "doc_id long, rid long, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<binary>"


def encode(docs: DataFrame, known: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as symbols, two starts before and an end behind, with what the head says of its words.

    base sums up the logarithms of the smoothed counts of words in the head and of the end; inside those of the head's
    words that share symbols; rare lists the words beyond the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    width = "<u2" if known.start < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(np.append(m.counts, m.ends) + 0.5)
        words_of_head = list(m.head)
        names = pa.array(words_of_head, pa.binary())
        symbol = np.concatenate((np.arange(min(m.own, len(words_of_head))), m.by_hash(words_of_head[m.own :]), [0]))
        of_known = np.append(logs[:-1], 0.0)  # the last place is that of words beyond the head
        beyond = np.where(np.arange(len(of_known)) >= m.own, of_known, 0.0)
        for batch in small_slices(batches, "text", 8192, 12_000_000):  # a lookup begins with a table of the head
            found, sizes = words(batch.column("text"))
            number = pc.index_in(found, value_set=names)
            rare = found.filter(number.is_null())
            number = number.fill_null(-1).to_numpy(zero_copy_only=False)
            unknown = np.flatnonzero(number < 0)
            taken = np.take(symbol, number)
            taken[unknown] = m.by_hash(rare.to_pylist())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.bincount(owner, np.take(x, number), len(sizes)) for x in (of_known, beyond)]
            some = np.bincount(owner[unknown], minlength=len(sizes))
            ends = np.cumsum(sizes)
            after = 3 * np.arange(len(sizes)) + ends  # where texts end, with what stands around them
            around = np.full(len(taken) + 3 * len(sizes), m.start, width)
            around[after + 2] = m.start - 1
            around[np.arange(len(taken)) + 3 * owner + 2] = taken
            rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, (after + 3) * around.itemsize).astype(np.int32)), pa.py_buffer(around)])
            offsets = pa.array(np.concatenate(([0], np.cumsum(some))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"), pa.array(sizes + 1), pa.array(sizes - some + (m.ends > 0), pa.int64()), pa.array(sums[0] + logs[-1], pa.float64()), pa.array(sums[1].astype(np.float64)), rows, pa.ListArray.from_arrays(offsets, rare)],
                names=[x.split()[0] for x in ENCODED.split(", ")],
            )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, ENCODED)


def _symbols(raw, known: Lexicon) -> list[np.ndarray]:
    width = "<u2" if known.start < 1 << 16 else "<u4"
    return [np.frombuffer(x, width).astype(np.int32) for x in raw]


def _before(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the texts with their two predecessors: (first, second, token)."""
    return tuple(np.concatenate([s[i : len(s) - 2 + i] for s in texts]) for i in range(3))


def train_on(encoded: DataFrame, known: Lexicon, steps: int = STEPS) -> Table:
    """Rounds of training by tasks that each read partitions of encoded texts, and the mean of what they learned; no token is left out."""
    spark, model, total = encoded.sparkSession, Bilinear(known.frequency), known.total
    least, parts = max(steps * BATCH, total), max(1, math.ceil(math.sqrt(total / PART)))
    batch = BATCH if total <= STEPS * BATCH else 2 * BATCH  # with more tokens than that there are steps enough
    for turn in range(ROUNDS if total else 0):
        start = spark.sparkContext.broadcast((known.frequency, known.start, model.flat()))

        def fit(batches: Iterator[pd.DataFrame], turn: int = turn, start=start) -> Iterator[pd.DataFrame]:
            frequency, last, flat = start.value
            mine, width = Bilinear(frequency), "<u2" if last < 1 << 16 else "<u4"
            mine.put(flat)
            mass, name, held, size = 0, None, [], 0

            def learn_held() -> None:
                nonlocal mass
                u, v, w = _before(held)
                order = visits(len(w), math.ceil(least * len(w) / total), turn, [name, mass])
                if len(order):
                    mine.descend(u, v, w, math.ceil(len(order) / batch), lambda p: _rate((turn + p) / ROUNDS), np.random.default_rng([turn, name, mass]), batch, order)
                mass += len(w)

            for b in batches:
                for rid, raw in zip(b["rid"], b["symbols"], strict=True):
                    name = int(rid) if name is None else name
                    held.append(np.frombuffer(raw, width).astype(np.int32))
                    size += len(held[-1])
                    if size >= HELD:
                        learn_held()
                        held, size = [], 0
            if held:
                learn_held()
            if mass:
                flat = mine.flat()
                for i in range(0, len(flat), BLOCK):
                    yield pd.DataFrame({"block": [i // BLOCK], "name": [name], "mass": [mass], "part": [flat[i : i + BLOCK].tobytes()]})

        def mean(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("name")  # sums of floats depend on their order
            out = sum(np.frombuffer(p, np.float32) * (m / parts["mass"].sum()) for p, m in zip(parts["part"], parts["mass"], strict=True))
            return pd.DataFrame({"block": parts["block"].iloc[:1], "part": [np.asarray(out, np.float32).tobytes()]})

        read = encoded.select("rid", "symbols").coalesce(parts)
        fitted = read.mapInPandas(fit, "block int, name long, mass long, part binary").groupBy("block").applyInPandas(mean, "block int, part binary")
        with shuffles_removed(spark):
            parts_ = sorted(fitted.collect(), key=lambda r: r["block"])
        model.put(np.concatenate([np.frombuffer(r["part"], np.float32) for r in parts_]))
        start.destroy()
    return model.table()


def score_encoded(encoded: DataFrame, known: Lexicon, tail: DataFrame, table: Table) -> DataFrame:
    """One row per encoded row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = encoded.sparkSession.sparkContext.broadcast((known, table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, model = shared.value
        masses = np.log10(m.mass)
        for whole in batches:
            size, at = whole["symbols"].str.len().cumsum().to_numpy(), 0
            while at < len(whole):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 800_000, "right")))
                batch, at = whole.iloc[at:to], to
                texts = _symbols(batch["symbols"], m)
                u, v, w = _before(texts)
                lbl = model.logs(u, v, w) / math.log(10)
                by_hash = (w >= m.own) & (w < m.own + m.shared)
                lbl[by_hash] -= masses[w[by_hash] - m.own]
                sums = np.add.reduceat(lbl, np.cumsum([0, *(len(s) - 2 for s in texts[:-1])]))
                yield pd.DataFrame({"rid": batch["rid"], "lbl": sums})

    lbl = encoded.select("rid", "symbols").mapInPandas(run, "rid long, lbl double")
    rare = encoded.where(F.size("rare") > 0).select("rid", F.explode("rare").alias("word"))
    found = rare.join(tail.select("word", "n"), "word", "left")  # no word beyond the head is frequent, so no key is hot
    sums = found.groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("known"))
    every = math.log10(known.total + 0.5 * (known.types + 1))
    joined = encoded.select("rid", "doc_id", "n_tokens", "n_known", "base", "inside").join(lbl, "rid").join(sums, "rid", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * every).alias("base_score"), (F.col("lbl") + F.col("inside") + logs).alias("score"),
    )


@dataclass
class Model:
    """A trained model: the words it knows, those beyond the head in a table, and its vectors."""

    known: Lexicon
    tail: DataFrame
    table: Table


def learn(docs: DataFrame, text_col: str = "text", head: int = HEAD, steps: int = STEPS) -> Model:
    """The model of all rows of ``docs``."""
    known, tail = lexicon(docs, text_col, head)
    encoded = materialise(encode(docs, known, docs.columns[0], text_col).select("rid", "symbols"), "encoded")
    table = train_on(encoded, known, steps)
    discard(encoded)
    return Model(known, tail, table)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: their only token is the end. Null and repeated ids are rows of their own; an empty table gives no
    rows. Without a training text, every token is unknown. Other columns are not read.
    """
    return score_encoded(materialise(encode(docs, model.known, id_col, text_col), "encoded"), model.known, model.tail, model.table)


def score_held_out(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, head: int = HEAD) -> DataFrame:
    """Scores of all rows by a model of those whose fold is not ``held``, with the column held_out; texts become symbols once."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_held = fold(F.col("doc_id"), folds) == held
    known, tail = lexicon(given.where(~is_held), "text", head)
    encoded = materialise(encode(given, known), "encoded")
    table = train_on(encoded.where(~is_held), known, steps)
    return score_encoded(encoded, known, tail, table).withColumn("held_out", is_held)
