"""An FM-index over word sequences: Burrows-Wheeler transform in a wavelet matrix.

All operations take arrays of patterns at once. Bits are packed 64 to a word with a
running count per word, so a rank is a look-up and a population count.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, "u1")
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(size, "i4")
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype="i4")
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a position, one bit vector per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit & 1).astype("u1")
            vector = Bits(bits)
            self.levels.append((bit, vector, len(bits) - vector.ones))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(alphabet)
        self.start = self._descend(every, np.zeros(alphabet, "i8"))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of a sequence of symbols from 0 to alphabet - 1, for patterns up to `depth`."""

    def __init__(self, sequence: np.ndarray, alphabet: int, depth: int):
        self.suffixes = suffix_order(sequence, depth)
        counts = np.bincount(sequence, minlength=alphabet)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.transform = WaveletMatrix(sequence[self.suffixes - 1], alphabet)

    def matching(self, sequence: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (exclusive) in `sequence`, the length of the longest match, up to
        `threshold`, of what precedes it with at least two places of the index, and the
        interval of suffixes that begin with it."""
        length = np.zeros(len(ends), "i8")
        low, high = np.zeros(len(ends), "i8"), np.full(len(ends), len(self.suffixes), "i8")
        active = np.arange(len(ends))
        for step in range(1, threshold + 1):
            at = ends[active] - step
            symbol = sequence[np.maximum(at, 0)]
            lo, hi = low[active], high[active]
            if step == 1:
                lo, hi = self.first[symbol], self.first[symbol + 1]
            else:
                lo = self.first[symbol] + self.transform.rank(symbol, lo)
                hi = self.first[symbol] + self.transform.rank(symbol, hi)
            going = (hi - lo >= 2) & (at >= 0)
            active, lo, hi = active[going], lo[going], hi[going]
            low[active], high[active], length[active] = lo, hi, step
            if not len(active):
                break
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position of each interval of suffixes."""
        if not len(low):
            return low
        starts, inverse = np.unique(low * (len(self.suffixes) + 1) + high, return_inverse=True)
        lo, hi = starts // (len(self.suffixes) + 1), starts % (len(self.suffixes) + 1)
        padded = np.append(self.suffixes, len(self.suffixes))
        # intervals of patterns of one length don't overlap, so every other reduction is one of them
        found = np.minimum.reduceat(padded, np.column_stack([lo, hi]).ravel())[::2]
        return found[inverse]


def suffix_order(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols at least, by doubling."""
    n = len(sequence)
    rank = sequence.astype("i8")
    span = 1
    while True:
        after = np.zeros(n, "i8")
        after[: n - span] = rank[span:] + 1
        key = rank * (max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        span *= 2
        if span >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, "i8")
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
