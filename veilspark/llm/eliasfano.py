"""Elias-Fano sequences over flat buffers, read by whole arrays of queries at once.

A sorted sequence of n numbers below ``universe`` keeps the low bits of each number packed and the high
bits in unary: the bit at (high part + index) is set. That is about 2 + log2(universe / n) bits a number.
The buffers can lie in a memory-mapped file; a query touches a few words of them.
"""

from __future__ import annotations

import numpy as np

#: Bits between two entries of the directories that say how many zeros or ones lie before.
BLOCK = 512


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
        up = k >= low
        k = k - np.where(up, low, 0)
        place += np.where(up, width, 0)
    return place


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.high, self.zeros, self.ones = n, low_bits, high, zeros, ones
        self.low_bytes = low
        # Any eight bytes in a row, so that a number's low bits come by one read.
        self.low = np.ndarray((max(0, len(low) - 7),), "<u8", low.data, 0, (1,)) if len(low) >= 8 else np.zeros(0, np.uint64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        """Of sorted uint64 numbers, all below ``universe``."""
        n = len(values)
        low_bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        parts = []
        for i in range(0, n, 1 << 18):  # a multiple of eight numbers fills whole bytes
            bits = np.unpackbits(values[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            parts.append(np.packbits(bits.ravel(), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        size = n + ((universe - 1) >> low_bits) + 2 if universe else 1
        size = -(-size // BLOCK) * BLOCK
        bits = np.zeros(size, bool)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high.reshape(-1, BLOCK // 64)).sum(axis=1, dtype=np.int64))])
        return EliasFano(n, low_bits, low, high, np.arange(len(before)) * BLOCK - before, before)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low_bytes, self.high, self.zeros.astype(np.int64), self.ones.astype(np.int64)]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, zeros, ones = arrays
        return EliasFano(int(head[0]), int(head[1]), low, high, zeros, ones)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high part."""
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        words = self.high.reshape(-1, BLOCK // 64)[block]
        if not ones:
            words = ~words
        left = k - directory[block]
        count = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (count <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(word > 0, count[rows, word - 1], 0)
        return block * BLOCK + word * 64 + _select_in_word(words[rows, word], left)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and those after them, which mostly have their bit in the same word."""
        place = self._select(i, True)
        shift = (place & 63).astype(np.uint64)
        rest = (self.high[place >> 6] >> shift) >> np.uint64(1)
        after = place + 1 + np.bitwise_count((rest & (np.uint64(0) - rest)) - np.uint64(1)).astype(np.int64)
        if (far := rest == 0).any():
            after[far] = self._select(i[far] + 1, True)
        return tuple(((p - j).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(j) for p, j in ((place, i), (after, i + 1)))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1 where the sequence lacks it: the successor search within the value's high part."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        last = int(self.zeros[-1]) - 1  # highest zero that exists
        inside = high < last
        high = np.minimum(high, last - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        # Ones up to the next zero are the numbers with this high part. Most runs end within the word.
        place = start + high
        word = place >> 6
        shift = (place & 63).astype(np.uint64)
        rest = ~(self.high[word] >> shift)
        run = np.bitwise_count((rest & (np.uint64(0) - rest)) - np.uint64(1)).astype(np.int64)
        crosses = run >= 64 - (place & 63)
        if crosses.any():
            run[crosses] = self._select(high[crosses], False) - place[crosses]
        found = np.full(len(values), -1, np.int64)
        at = np.flatnonzero(inside & (run > 0))
        a, b = start[at], start[at] + run[at]
        while len(at):  # binary search, all queries at once
            middle = (a + b) >> 1
            own = self._low(middle)
            wanted = low[at]
            hit = own == wanted
            found[at[hit]] = middle[hit]
            up = own < wanted
            a, b = np.where(up, middle + 1, a), np.where(up, b, middle)
            on = ~hit & (a < b)
            at, a, b = at[on], a[on], b[on]
        return found
