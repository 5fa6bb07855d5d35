"""Words and word windows of many texts at once, hashed with numpy.

A word's hash is a pair of polynomials over its bytes modulo two primes, mixed; prefix
sums give them without a loop.  A window's hash joins those of its halves again and
again, which is no polynomial.  These hashes only find candidates; what must be equal
is compared by ``digests`` of the words themselves.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Prime moduli below 2^31 and a base for each.
_MODULI = ((2147483647, 1284865837), (2147483629, 1103515245))
#: Bytes of a word up to which its sums stay below 2^64.
_LONG = 1 << 24


@lru_cache(8)
def _powers(base: int, modulus: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint32)  # half the room of the products
    out[:1] = 1
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(int(out[done - 1]) * base % modulus) % np.uint64(modulus)
        done += more
    return out


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) by the modulus."""
    size = 1 << max(10, int(n - 1).bit_length())
    return _powers(base, modulus, size)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair of hashes."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) + np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words of the texts: where each starts and ends, and its text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        solid = ~BLANK[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
        begins[first], ends[last] = solid[first], solid[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(at, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(at) - 1)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.zeros(len(self.starts), np.uint64)
        for modulus, base in _MODULI:
            m = np.uint64(modulus)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, modulus, len(self.data)), out=sums[1:])
            back = powers(pow(base, -1, modulus), modulus, len(self.data) + 1)
            out = (out << np.uint64(32)) + (sums[self.ends] - sums[self.starts]) % m * back[self.starts] % m
        for k in np.flatnonzero(self.ends - self.starts > _LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.starts[k] : self.ends[k]], digest_size=8).digest(), "little")
        return mixed(out)

    def windows(self, n: int, rows: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
        """First word, and so many independent 64-bit hashes, of each window of n words."""
        first = np.arange(max(0, len(self.doc) - n + 1))
        first = first[self.doc[first] == self.doc[first + n - 1]]
        own, out = self.hashes(), []
        for row in range(rows):
            h = mixed(own + np.uint64((2 * row + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
            whole, done, size = None, 0, 1  # h: of ``size`` words from each place on
            while True:
                if n & size:
                    part = h[first + done]
                    whole = part if whole is None else joined(whole, part)
                    done += size
                if done == n:
                    break
                h = joined(h[:-size], h[size:])
                size *= 2
            out.append(whole)
        return first, out

    def digests(self, first: np.ndarray, n: int) -> np.ndarray:
        """Of the windows that start at the given words: 128 bits of BLAKE2b of their words,
        as rows of two numbers."""
        follows = np.zeros(len(self.doc), np.int64)
        follows[:-1] = self.doc[1:] == self.doc[:-1]
        sizes = self.ends - self.starts
        at = np.cumsum(sizes + follows) - (sizes + follows)
        view = memoryview(self.kept_texts(np.zeros(len(self.doc), bool))[0])
        bounds = zip(at[first].tolist(), (at + sizes)[first + n - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in bounds]), np.uint64).reshape(-1, 2)

    def covered(self, first: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in the windows that start at the given words."""
        steps = np.zeros(len(self.doc) + 1, np.int32)
        np.add.at(steps, first, 1)
        np.add.at(steps, first + n, -1)
        return np.cumsum(steps[:-1]) > 0

    def kept_texts(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of the texts with the other words joined by a space."""
        starts, ends, doc = self.starts[~gone], self.ends[~gone], self.doc[~gone]
        follows = np.zeros(len(doc), bool)
        follows[:-1] = doc[1:] == doc[:-1]
        steps = np.zeros(len(self.data) + 2, np.int8)
        steps[starts] += 1
        np.add.at(steps, ends + follows, -1)
        data = self.data.copy()
        data[ends[follows]] = 0x20
        inside = np.cumsum(steps[: len(data)], dtype=np.int8) > 0
        lengths = np.bincount(doc, weights=ends - starts + follows, minlength=len(self.at) - 1).astype(np.int64)
        return data[inside], np.concatenate([[0], np.cumsum(lengths)])
