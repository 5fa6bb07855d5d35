"""A hidden Markov model over symbols: scaled forward recursion, Baum-Welch counts.

Sequences are worked on side by side, step by step, each from its first to its last
symbol.  Forward vectors are kept for a block of steps at a time; those of earlier
blocks are worked out again from the vectors at the block's start, so memory doesn't
grow with the vectors of all steps.
"""

from __future__ import annotations

import numpy as np


class Hmm:
    """start (S), move (S, S) and emit (M, S): probabilities, states last."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The exact log10 likelihood of each sequence of symbols."""
        out = np.zeros(len(sequences))
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        flat, active, at = by_time([sequences[k] for k in order])
        total = np.zeros(len(order))
        a = self.start * self.emit[flat[: active[0]]]
        for t, n in enumerate(active.tolist()):
            if t:
                a = (a[:n] @ self.move) * self.emit[flat[at[t] : at[t + 1]]]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:n] += np.log10(scale)
        out[order] = total
        return out


def by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as one array ordered by time, with the number of
    sequences that reach each time and where each time starts."""
    lengths = np.array([len(s) for s in sequences])
    active = np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1)[::-1])[::-1][1:]
    at = np.concatenate([[0], np.cumsum(active)])
    joined = np.concatenate(sequences)
    first = np.cumsum(lengths) - lengths
    who = np.repeat(np.arange(len(sequences)), lengths)
    flat = np.empty(len(joined), joined.dtype)
    flat[at[np.arange(len(joined)) - first[who]] + who] = joined
    return flat, active, at


class Counts:
    """Expected counts of Baum-Welch; they add up over documents and partitions."""

    def __init__(self, states: int, symbols: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((symbols, states))
        self.log = 0.0

    def add(self, model: Hmm, documents: list[np.ndarray], room: int = 2_000_000) -> None:
        """Adds the exact expected counts of whole documents; room: symbols whose forward
        vectors are kept at a time."""
        own = sorted((d for d in documents if len(d)), key=len, reverse=True)
        if not own:
            return
        flat, active, at = by_time(own)
        emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
        cuts = [0]
        for t in range(1, len(active)):
            if at[t + 1] - at[cuts[-1]] > room:
                cuts.append(t)
        cuts.append(len(active))

        def forward(k: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Vectors and scales of a block after the vectors a, and its last ones."""
            low, high = cuts[k], cuts[k + 1]
            alpha = np.empty((at[high] - at[low], len(move)), np.float32)
            scale = np.empty(len(alpha), np.float32)
            for t in range(low, high):
                n, here = active[t], slice(at[t] - at[low], at[t + 1] - at[low])
                a = (model.start.astype(np.float32) if a is None else a[:n] @ move) * emit[flat[at[t] : at[t + 1]]]
                total = a.sum(1)
                a /= total[:, None]
                alpha[here], scale[here] = a, total
            return a, alpha, scale

        entry, a = [], None  # of each block: the vectors before it
        for k in range(len(cuts) - 1):
            entry.append(a)
            a, alpha, scale = forward(k, a)
        beta = np.ones((len(own), len(move)), np.float32)
        pairs = np.zeros(move.shape)
        for k in range(len(cuts) - 2, -1, -1):
            low, high = cuts[k], cuts[k + 1]
            if high != len(active):
                _, alpha, scale = forward(k, entry[k])
            self.log += float(np.log10(scale, dtype=np.float64).sum())
            for t in range(high - 1, low - 1, -1):
                n, here = active[t], slice(at[t] - at[low], at[t + 1] - at[low])
                w = emit[flat[at[t] : at[t + 1]]] * beta[:n] / scale[here][:, None]
                alpha[here] *= beta[:n]  # now the chances of the states
                before = alpha[at[t - 1] - at[low] :][:n] if t > low else entry[k]
                if before is not None:
                    pairs += before[:n].T @ w
                    beta[:n] = w @ move.T
            if not k:
                self.start += alpha[: len(own)].sum(0)
            for s in range(len(move)):
                self.emit[:, s] += np.bincount(flat[at[low] : at[high]], weights=alpha[:, s], minlength=len(self.emit))
        self.move += pairs * move

    def model(self, prior: np.ndarray, weight: float = 50.0) -> Hmm:
        """The model of these counts, emissions smoothed with a symbol prior."""
        start = self.start + 0.1
        move = self.move + 0.1
        emit = self.emit + weight * prior[:, None]
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def first_model(documents: list[np.ndarray], states: int, prior: np.ndarray, rounds: int = 8) -> Hmm:
    """A start for Baum-Welch: a mixture of symbol distributions over a few
    documents, seeded with documents far apart, made into sticky states."""
    symbols = len(prior)
    own = [d for d in documents if len(d)]
    x = np.zeros((max(1, len(own)), symbols), np.float32)
    for i, d in enumerate(own):
        np.add.at(x[i], d, 1)
    unit = np.sqrt(x)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    seeds = [int(x.sum(1).argmax())]
    near = unit @ unit[seeds[0]]
    while len(seeds) < states:
        seeds.append(int(np.where(x.sum(1) >= np.median(x.sum(1)), near, 2).argmin()))
        near = np.maximum(near, unit @ unit[seeds[-1]])
    weight = np.full(states, 1 / states)
    emit = x[seeds] + 20 * prior
    for _ in range(rounds):
        emit /= emit.sum(1, keepdims=True)
        log = x @ np.log(emit).T + np.log(weight)
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = (p.sum(0) + 1) / (p.sum() + states)
        emit = p.T @ x + 20 * prior
    emit = (emit / emit.sum(1, keepdims=True)).T.astype(float)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Hmm(weight / weight.sum(), move / move.sum(1, keepdims=True), emit)
