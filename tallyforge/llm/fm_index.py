"""A compressed FM-index over integer symbols, with all queries of a batch searched at once.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with rank samples.
Suffixes are sorted to a bounded depth, which is enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """Packed bits with a rank sample per 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Rank of a symbol in a prefix, for arrays of symbols and positions."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.bits.append(_Bits(bit))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(size)
        self.base = self._walk(every, np.zeros(size, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            r = bits.rank(i)
            i = np.where(one, bits.zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.base[c]


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.astype(np.int64) * (int(b.max()) + 1) + b
    order = np.argsort(key, kind="stable")
    step = np.zeros(len(key), np.int64)
    s = key[order]
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def depth_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position the rank of the next ``depth`` symbols (text goes on with zeros)."""
    have, r = 1, text.astype(np.int64)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:] + 1, np.zeros(min(k, len(x)), np.int64)])

    while have < depth:
        step = min(have, depth - have)
        r = _pair_ranks(r, ahead(r, step))
        have += step
    return r


class FMIndex:
    """``text``: symbols from 1 to size - 1, and 0 between pieces."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.ranks = depth_ranks(text, depth)
        self.suffixes = np.argsort(self.ranks, kind="stable")
        count = np.bincount(text, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.wavelet = Wavelet(text[self.suffixes - 1], size)  # before the first symbol stands the last

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the ``length`` symbols of ``text`` before each of ``ends``, by
        backward search of all at once: the interval of suffixes that start with the last
        ``matched`` symbols.  A pattern is left once a single suffix matches it."""
        c = text[ends - 1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        matched = np.ones(len(ends), np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for step in range(2, length + 1):
            if not len(live):
                break
            c = text[ends[live] - step]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            low, high = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            found = high > low
            lo[live[found]], hi[live[found]] = low[found], high[found]
            matched[live[found]] = step
            live = live[found & (high - low > 1)]
        return lo, hi, matched
