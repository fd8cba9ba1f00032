"""Elias-Fano coding of a non-decreasing sequence, with select."""

from __future__ import annotations

import struct

import numpy as np

#: A position is noted for every so many ones.
STEP = 64
HEAD = struct.Struct("<QQB3xII")


class EliasFano:
    """n values in [0, universe]: l low bits of each in a row, the rest in unary.

    Takes about n * (2 + log2(universe / n)) bits, and 32 bits for every 64 values so that
    select looks at a few bytes only. Empty sequences are fine; ties are fine.
    """

    def __init__(self, n: int, universe: int, l: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.universe, self.l, self.low, self.high, self.marks = n, universe, l, low, high, marks

    @classmethod
    def encode(cls, values, universe: int | None = None) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        universe = top if universe is None else universe
        if universe < top or (n and (v[1:] < v[:-1]).any()):
            raise ValueError("values must be non-decreasing and within the universe")
        l = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros((universe >> l) + n + 1, np.uint8)
        unary[ones] = 1
        return cls(n, universe, l, low, np.packbits(unary, bitorder="little"), ones[::STEP].astype("<u4"))

    def select(self, i: int) -> int:
        """The value at i, from a mark and a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // STEP]), i % STEP
        byte, skip = at >> 3, at & 7
        word = int(self.high[byte]) >> skip << skip
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.l):
            b = i * self.l + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return ((one - i) << self.l) | low

    def values(self) -> np.ndarray:
        """All values, as int64."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.l
        if self.l and self.n:
            bits = np.unpackbits(self.low, count=self.n * self.l, bitorder="little").reshape(self.n, self.l)
            high |= bits.astype(np.int64) @ (1 << np.arange(self.l, dtype=np.int64))
        return high

    def to_bytes(self) -> bytes:
        body = self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()
        return HEAD.pack(self.n, self.universe, self.l, len(self.low), len(self.high)) + body

    @classmethod
    def from_bytes(cls, data) -> tuple[EliasFano, int]:
        """The sequence at the start of data, and the bytes it takes."""
        n, universe, l, a, b = HEAD.unpack_from(data)
        at = HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        marks = np.frombuffer(data, "<u4", -(-n // STEP), at + a + b)
        return cls(n, universe, l, low, high, marks), at + a + b + 4 * len(marks)
