"""Elias-Fano coding of monotone integer sequences over numpy arrays, with vectorised access and successor search.

A value is cut into low bits, packed one after the other, and a high part; the high parts are stored as a bit vector in
which value number i sets bit (high + i). A small directory counts the set bits before each word of that vector.
"""

from __future__ import annotations

import numpy as np

WORD = np.uint64
ONE, SIX, LAST = WORD(1), WORD(6), WORD(63)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` (uint64) as ``width`` bits each, in 64-bit words; a word of zeros ends them."""
    out = np.zeros(len(values) * width // 64 + 2, WORD)
    if width and len(values):
        bit = np.arange(len(values), dtype=WORD) * WORD(width)
        word, shift = (bit >> SIX).astype(np.int64), bit & LAST
        np.bitwise_or.at(out, word, values << shift)
        over = shift + WORD(width) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (WORD(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), WORD)
    bit = at.astype(WORD) * WORD(width)
    word, shift = (bit >> SIX).astype(np.int64), bit & LAST
    high = np.where(shift > 0, words[word + 1] << ((WORD(64) - shift) & LAST), WORD(0))
    return ((words[word] >> shift) | high) & WORD((1 << width) - 1)


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of set bit number ``n`` (from 0) of each word, by halving."""
    place, left = np.zeros(len(words), WORD), n.astype(np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count((words >> place) & WORD((1 << size) - 1)).astype(np.int64)
        up = left >= count
        left -= np.where(up, count, 0)
        place += np.where(up, WORD(size), WORD(0))
    return place


class EliasFano:
    """``values``: sorted uint64, below ``universe``. ``arrays`` are the parts to store."""

    def __init__(self, length: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.length, self.width, self.low, self.high, self.ones = length, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        top = int(universe >> width) + 1
        high = np.zeros((n + top) // 64 + 1, WORD)
        at = (values >> WORD(width)) + np.arange(n, dtype=WORD)
        np.bitwise_or.at(high, (at >> SIX).astype(np.int64), ONE << (at & LAST))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, width, pack(values & WORD((1 << width) - 1), width), high, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.length, self.width], np.int64), self.low, self.high, self.ones]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        counts = self.zeros if zeros else self.ones
        word = np.searchsorted(counts, k, side="right") - 1
        bits = self.high[word]
        return word * 64 + _nth_bit(~bits if zeros else bits, k - counts[word]).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        high = (self._select(i, False) - i).astype(WORD)
        return (high << WORD(self.width)) | unpack(self.low, self.width, i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the successor search runs among the values of the same high part only."""
        if not self.length:
            return np.full(len(values), -1)
        high = (values >> WORD(self.width)).astype(np.int64)
        inside = high < self.zeros[-1]
        high = np.where(inside, high, 0)
        low = values & WORD((1 << self.width) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        end = self._select(high, True) - high
        first, last = begin, end.copy()
        while (open_ := first < last).any():
            middle = (first + last) // 2
            less = open_ & (unpack(self.low, self.width, np.minimum(middle, self.length - 1)) < low)
            first, last = np.where(less, middle + 1, first), np.where(open_ & ~less, middle, last)
        at = np.minimum(first, self.length - 1)
        return np.where(inside & (first < end) & (unpack(self.low, self.width, at) == low), at, -1)
