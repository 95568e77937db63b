"""Training of the language model visits every token."""

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import lm_scoring


@pytest.mark.parametrize(("n", "total"), [(1, 1), (1, 50_000), (3, 7), (999, 10), (5000, 5000), (5000, 12_345), (70_000, 70_000)])
def test_every_token_is_visited(n, total):
    rounds = [lm_scoring.visits(n, total, turn, [5, 7]) for turn in range(lm_scoring.ROUNDS)]
    seen = np.bincount(np.concatenate(rounds), minlength=n)
    assert len(seen) == n and seen.min() >= 1 and seen.sum() == max(n, total)
    assert max(map(len, rounds)) - min(map(len, rounds)) <= 1


def test_noise_of_a_batch_has_the_rates_of_its_draws():
    """Shared draws name groups, and targets inside them, as often as every token's own would on average."""
    frequency = 1000 / np.arange(1, 38)
    model = lm_scoring.Bilinear(frequency)
    drawn = [model.noise(np.random.default_rng(k)) for k in range(500)]
    assert all(g.sum() == lm_scoring.NOISE and np.allclose(w.sum(1), lm_scoring.INNER) for g, w in drawn)
    share = (frequency + 0.5) / (frequency + 0.5).sum()
    group = np.add.reduceat(share, model.starts)
    inner = np.zeros(drawn[0][1].size)
    inner[: len(share)] = share / group[np.arange(len(share)) // model.size]
    assert np.allclose(np.mean([g for g, _ in drawn], axis=0), lm_scoring.NOISE * group, atol=0.1)
    assert np.allclose(np.mean([w for _, w in drawn], axis=0).ravel(), lm_scoring.INNER * inner, atol=0.1)
    assert (drawn[0][1].ravel()[len(share) :] == 0).all()


def test_a_step_is_the_gradient_of_the_contrast():
    """One step from the start changes every bias by the derivative of the loss, by plain loops, over its root of squares."""
    rng = np.random.default_rng(1)
    model = lm_scoring.Bilinear(1000 / np.arange(1, 11), width=4)
    u, v, w = rng.integers(0, 11, 40), rng.integers(0, 11, 40), rng.integers(0, 10, 40)
    of_group, of_word = model.noise(np.random.default_rng(9))
    q, g, h = model.q.copy(), model.g.copy(), model.r[u] @ model.c[0] + model.r[v] @ model.c[1]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    bias, of = np.zeros(len(q)), np.zeros(len(g))
    for i, t in enumerate(w):
        k = t // model.size
        for j in range(len(g)):
            of[j] += of_group[j] * sigmoid(h[i] @ g[j, :-1] + g[j, -1]) - (j == k) * (1 - sigmoid(h[i] @ g[j, :-1] + g[j, -1]))
        for j in range(k * model.size, min((k + 1) * model.size, 10)):
            bias[j] += of_word[k, j % model.size] * sigmoid(h[i] @ q[j, :-1] + q[j, -1]) - (j == t) * (1 - sigmoid(h[i] @ q[j, :-1] + q[j, -1]))
    model.descend(u, v, w, 1, lambda _: 0.1, np.random.default_rng(9), 40, np.arange(40))
    assert np.allclose(model.q[:, -1], q[:, -1] - 0.1 * bias / np.sqrt(0.01 + bias**2), atol=1e-4)
    assert np.allclose(model.g[:, -1], g[:, -1] - 0.1 * of / np.sqrt(0.01 + of**2), atol=1e-4)


@pytest.mark.parametrize(("n", "batch", "groups"), [(1, 1, 1), (4096, 512, 40), (4000, 500, 9), (3 * 64, 64, 100)])
def test_a_window_is_dealt_whole_and_a_rare_group_meets_few_batches(n, batch, groups):
    rng = np.random.default_rng(2)
    at = np.minimum((rng.pareto(1, n) * 2).astype(int), groups - 1)
    order = lm_scoring.deal(at, batch, groups, rng)
    assert sorted(order.tolist()) == list(range(n))
    count, batches = np.bincount(at, minlength=groups), at[order].reshape(-1, batch)
    met = sum(len(np.unique(b)) for b in batches)
    rare = (count > 0) & (count * lm_scoring.RARE <= n)
    assert met <= (count > 0).sum() + len(batches) + (len(batches) - 1) * ((count > 0) & ~rare).sum()


def test_words_are_those_between_ascii_white_space():
    rng = np.random.default_rng(3)
    parts = [b"A", b"z", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xc2\xa0", b"\xff", b"\xc3\x84", b"\x00", b"\xe2\x80\x83"]
    texts = [b"", b" ", b"\n\n", *(b"".join(parts[i] for i in rng.integers(0, len(parts), k)) for k in rng.integers(0, 30, 500))]
    for some in (texts, texts[3:], []):
        found, sizes = lm_scoring.words(pa.array(texts, pa.binary()).slice(len(texts) - len(some)))
        expected = [t.lower().split() for t in some]
        assert sizes.tolist() == [len(x) for x in expected] and found.to_pylist() == [w for x in expected for w in x]
