"""Elias-Fano coded monotone sequences, read in place from memory-mapped arrays.

A value's low bits are packed; its high part is the number of zeros before its one
bit in a bit vector.  Counts of ones before each word of the vector give rank and
select.  All reads work on whole arrays of positions.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one bit with ``rank`` ones before it."""
    word, rank = word.copy(), rank.astype(np.int64)
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        go = rank >= ones
        rank -= np.where(go, ones, 0)
        at += np.where(go, width, 0)
        word = np.where(go, word >> np.uint64(width), word)
    return at


class EliasFano:
    """Read access to the arrays that ``encode`` made."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.bits = (int(x) for x in arrays[prefix + "shape"])
        self.low, self.high, self.ones = (arrays[prefix + k] for k in ("low", "high", "ones"))

    @staticmethod
    def encode(values: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
        """Arrays for a non-decreasing uint64 sequence."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(62, max(0, (top // max(n, 1)).bit_length() - 1))
        words = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        ones_at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones_at[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, ones_at >> 6, _ONE << (ones_at & 63).astype(np.uint64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return {prefix + "shape": np.array([n, bits], np.int64), prefix + "low": words, prefix + "high": high, prefix + "ones": ones.astype(np.uint32)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (v | rest) & np.uint64((1 << self.bits) - 1)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))

    def _ones_before_bucket(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``bucket``: ones before the zero of rank bucket-1."""
        out = np.zeros(len(bucket), np.int64)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        some = (bucket > 0) & (bucket <= zeros[-1])
        rank = bucket[some] - 1
        word = np.searchsorted(zeros, rank, side="right") - 1
        at = word * 64 + _select_in_word(self.high[word] ^ _FULL, rank - zeros[word])
        out[some] = at - rank
        out[bucket > zeros[-1]] = self.n
        return np.minimum(out, self.n)

    def values(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, target: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each target in [lo, hi), or -1: its high part gives a range, whose low bits are searched."""
        out = np.full(len(target), -1, np.int64)
        if not self.n:
            return out
        bucket = (target >> np.uint64(self.bits)).astype(np.int64)
        at, last = self._ones_before_bucket(bucket), self._ones_before_bucket(bucket + 1)
        if lo is not None:
            at, last = np.maximum(at, lo), np.minimum(last, hi)
        wanted = target & np.uint64((1 << self.bits) - 1)
        todo = np.flatnonzero(at < last)
        at, last, wanted = at[todo], last[todo], wanted[todo]
        while len(todo):  # halve what is left of each range
            middle = (at + last) >> 1
            low = self._low(middle)
            hit = low == wanted
            out[todo[hit]] = middle[hit]
            below = low < wanted
            at, last = np.where(below, middle + 1, at), np.where(below, last, middle)
            on = ~hit & (at < last)
            todo, at, last, wanted = todo[on], at[on], last[on], wanted[on]
        return out
