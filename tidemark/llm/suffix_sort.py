"""Suffix sort of sampled positions by hashed common extensions.

Prefix polynomial hashes of the text (modulo 2^64) give the hash of any substring in constant
time; a binary search over lengths finds the longest common extension of two suffixes, so a
comparison takes logarithmic time. The sort is a bottom-up mergesort: at each level every element
finds its place in the neighbouring run by binary search, all elements at once.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.full(n, BASE, np.uint64)
            cls.down = np.full(n, INVERSE, np.uint64)
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)
        return cls.up[:n], cls.down[:n]


class Text:
    """Bytes with prefix hashes."""

    def __init__(self, raw: bytes):
        self.bytes = raw
        self.raw = np.frombuffer(raw, np.uint8)
        n = len(self.raw)
        up, self.down = Powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the substrings [at, at + size)."""
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at i and j, most at most, by binary search."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes(i, middle) == self.hashes(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the substrings are equal byte for byte."""
        raw = self.bytes
        return np.array([raw[a : a + n] == raw[b : b + n] for a, b, n in zip(i.tolist(), j.tolist(), size.tolist(), strict=True)], bool)


def merge_sort(text: Text, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes [at, at + size) by (group, bytes), and each one's extension with the one before it in its group.

    group must not decrease along the input. Equal suffixes keep their order.
    """
    n = len(at)
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; ties: whether equal ones do."""
        most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
        common = text.extension(at[x], at[y], most)
        ended = common == most
        last = len(text.raw) - 1
        by_byte = text.raw[np.minimum(at[x] + common, last)] < text.raw[np.minimum(at[y] + common, last)]
        by_size = (size[x] < size[y]) | ((size[x] == size[y]) & ties)
        return np.where(group[x] != group[y], group[x] < group[y], np.where(ended, by_size, by_byte))

    width = 1
    while width < n:
        start = np.arange(n) // (2 * width) * (2 * width)
        in_left = np.arange(n) - start < width
        other = np.where(in_left, start + width, start)
        low, high = np.minimum(other, n), np.minimum(np.where(in_left, start + 2 * width, start + width), n)
        first = low.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            goes = before(order[middle], order[live], ~in_left[live])
            low[live] = np.where(goes, middle + 1, low[live])
            high[live] = np.where(goes, high[live], middle)
            live = live[low[live] < high[live]]
        own = np.arange(n) - np.where(in_left, start, start + width)
        place = start + own + (low - first)
        moved = np.empty(n, np.int64)
        moved[place] = order
        order = moved
        width *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        x, y = order[:-1], order[1:]
        most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
        common[1:] = text.extension(at[x], at[y], most)
    return order, common
