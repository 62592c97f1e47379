"""Linear-chain conditional random fields in numpy batches.

Sequences of a batch advance together, longest first: step t of all of them is one
slice of a time-major array, so each step is a few vector operations and no sequence
is cut. Emissions come in document-major order as (tokens, states).
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where each token of the sequences stands in time-major order."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(counts.max(initial=0))
        active = len(counts) - np.cumsum(np.bincount(counts, minlength=longest + 1))[:longest]
        self.cuts = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        t = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
        self.pos = self.cuts[t] + np.repeat(rank, counts)
        self.bounds = bounds

    def steps(self) -> list[tuple[int, int]]:
        cuts = self.cuts.tolist()
        return list(zip(cuts[:-1], cuts[1:]))


def marginals(emission: np.ndarray, counts: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posterior of each token's state by forward-backward; with ``pairs`` also the expected transitions and the log likelihood's normaliser."""
    lay = Layout(counts)
    e = np.empty_like(emission)
    top = emission.max(1, keepdims=True)
    e[lay.pos] = np.exp(emission - top)
    alpha = np.empty_like(e)
    scale = np.empty(len(e), e.dtype)
    move = np.exp(trans).astype(e.dtype)
    steps = lay.steps()
    last = None
    for a, b in steps:
        x = e[a:b] * (np.exp(start).astype(e.dtype) if last is None else last[: b - a] @ move)
        s = x.sum(1)
        x /= s[:, None]
        scale[a:b] = s
        alpha[a:b] = last = x
    gamma = np.empty_like(e)
    expected = np.zeros((len(start), len(start)))
    beta = np.ones((0, e.shape[1]), e.dtype)
    for i in range(len(steps) - 1, -1, -1):
        a, b = steps[i]
        full = np.ones((b - a, e.shape[1]), e.dtype)
        full[: len(beta)] = beta
        gamma[a:b] = alpha[a:b] * full
        w = e[a:b] * full / scale[a:b, None]
        if i:
            if pairs:
                expected += (alpha[steps[i - 1][0] : steps[i - 1][0] + b - a].T @ w) * move
            beta = w @ move.T
    gamma /= gamma.sum(1, keepdims=True)
    if pairs:
        return gamma[lay.pos], expected, float(np.log(scale).sum() + top.sum())
    return gamma[lay.pos]


def viterbi(emission: np.ndarray, counts: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best state of each token; ties go to the lower state."""
    lay = Layout(counts)
    e = np.empty_like(emission)
    e[lay.pos] = emission
    back = np.zeros(e.shape, np.int8)
    steps = lay.steps()
    best = np.zeros(len(e), np.int8)
    last = None
    into = np.ascontiguousarray(trans.T)  # into[j, i]: from i to j
    score = []
    for a, b in steps:
        if last is None:
            last = e[a:b] + start
        else:
            n = b - a
            if n < len(last):
                score.append((len(last), last[n:].argmax(1)))
            via = last[:n, None, :] + into
            w = via.argmax(2)
            back[a:b] = w
            last = np.take_along_axis(via, w[:, :, None], 2)[:, :, 0] + e[a:b]
    if last is not None:
        score.append((len(last), last.argmax(1)))
    state = np.zeros(0, np.int64)
    ends = list(reversed(score))
    k = 0
    for i in range(len(steps) - 1, -1, -1):
        a, b = steps[i]
        n = b - a
        while len(state) < n:  # sequences that end here
            state = np.concatenate([state, ends[k][1]])
            k += 1
        best[a:b] = state
        state = back[a:b][np.arange(n), state].astype(np.int64)
    return best[lay.pos]


def fit(features: list[np.ndarray], size: int, tags: np.ndarray, counts: np.ndarray, states: int, rounds: int = 60, rate: float = 0.1, l2: float = 1e-5):
    """Weights (size, states), start and transitions that maximise the penalised likelihood, by Adam over the whole training table.

    ``features``: arrays of hashed feature numbers, one of each for every token; a -1 is no feature.
    """
    w = np.zeros((size, states), np.float64)
    start, trans = np.zeros(states), np.zeros((states, states))
    n = len(tags)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    hot = np.eye(states)[tags]
    first = hot[bounds[:-1][counts > 0]].sum(0)
    inner = np.ones(n, bool)
    inner[bounds[:-1][counts > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((states, states))
    np.add.at(seen, (tags[at - 1], tags[at]), 1)
    used, packed = np.unique(np.concatenate(features), return_inverse=True)
    packed = packed.reshape(len(features), n)
    none = used < 0
    v = np.zeros((len(used), states))
    params, moments = [v, start, trans], [[np.zeros_like(x), np.zeros_like(x)] for x in (v, start, trans)]
    for step in range(1, rounds + 1):
        emission = sum(v[f] for f in packed)
        gamma, expected, _ = marginals(emission, counts, start, trans, pairs=True)
        diff = hot - gamma
        grad = np.zeros_like(v)
        for s in range(states):
            for f in packed:
                grad[:, s] += np.bincount(f, diff[:, s], len(used))
        grad[none] = 0
        grads = [grad / n - l2 * v, (first - gamma[bounds[:-1][counts > 0]].sum(0)) / n, (seen - expected) / n]
        for x, g, m in zip(params, grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    v[none] = 0
    w[used[~none]] = v[~none]
    return w.astype(np.float32), start.astype(np.float32), trans.astype(np.float32)
