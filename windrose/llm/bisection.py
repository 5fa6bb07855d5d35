"""Recursive graph bisection: documents with terms in common come to lie side by side.

Documents are split into halves, and pairs of documents change sides as long as that
shortens the logarithms of the gaps in the terms' posting lists; then each half is split
in turn.  The halves' term degrees also tell where a document that wasn't there when
the tree was made belongs: on the side that its terms cost less, by the cut that halves
the documents the tree was made of.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Buckets of terms, by CRC-32.
BUCKETS = 1 << 14


def buckets(terms) -> np.ndarray:
    """The distinct buckets of the terms, in order."""
    return np.unique(np.fromiter((zlib.crc32(t) & (BUCKETS - 1) for t in terms), np.int32))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def _gap_bits(degree: np.ndarray, size: int) -> np.ndarray:
    """What the gaps of terms of these degrees take among so many documents."""
    return degree * np.log2(size / (degree + 1.0))


def _halved(terms: np.ndarray, at: np.ndarray, rounds: int) -> np.ndarray:
    """Which documents (terms between the bounds) go to the right half."""
    n = len(at) - 1
    right = np.arange(n) >= n // 2
    owner = np.repeat(np.arange(n), np.diff(at))
    sizes = n // 2, n - n // 2
    for _ in range(rounds):
        low, high = (np.bincount(terms[right[owner] == side], minlength=BUCKETS).astype(np.float64) for side in (False, True))
        now = _gap_bits(low, sizes[0]) + _gap_bits(high, sizes[1])
        to_right = now - _gap_bits(np.maximum(low - 1, 0), sizes[0]) - _gap_bits(high + 1, sizes[1])
        to_left = now - _gap_bits(low + 1, sizes[0]) - _gap_bits(np.maximum(high - 1, 0), sizes[1])
        gain = _sums(np.where(right[owner], to_left[terms], to_right[terms]), at)
        a, b = (np.flatnonzero(right == side) for side in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swaps = int((gain[a[:k]] + gain[b[:k]] > 0).sum())  # falls along the pairs
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    return right


class Tree:
    """The bisections of a bounded set of documents, each a sorted array of buckets."""

    def __init__(self, docs: list[np.ndarray], depth: int = 6, rounds: int = 20):
        self.depth = depth
        self.costs = np.zeros((2**depth - 1, BUCKETS), np.float32)  # left less right, of a term
        self.cuts = np.zeros(2**depth - 1)
        groups = {0: np.arange(len(docs))}
        for node in range(2**depth - 1):
            own = groups.pop(node, np.zeros(0, int))
            if len(own) < 4:
                groups[2 * node + 1], groups[2 * node + 2] = own, own[:0]
                continue
            at = np.concatenate([[0], np.cumsum([len(docs[k]) for k in own])])
            terms = np.concatenate([docs[k] for k in own])
            right = _halved(terms, at, rounds)
            owner = np.repeat(np.arange(len(own)), np.diff(at))
            low, high = (np.bincount(terms[right[owner] == side], minlength=BUCKETS) for side in (False, True))
            self.costs[node] = np.log2((high + 1) / max(1, right.sum())) - np.log2((low + 1) / max(1, (~right).sum()))
            self.cuts[node] = np.median(_sums(self.costs[node][terms], at))
            groups[2 * node + 1], groups[2 * node + 2] = own[~right], own[right]

    def leaves(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf, from 0, in the order of the bisections, of each document."""
        node = np.zeros(len(at) - 1, np.int64)
        sizes = np.diff(at)
        for _ in range(self.depth):
            cost = _sums(self.costs[np.repeat(node, sizes), terms], at)
            node = 2 * node + 1 + (cost > self.cuts[node])
        return node - (2**self.depth - 1)
