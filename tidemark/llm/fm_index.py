"""FM-index over integer symbols: suffix sort, wavelet ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of text by prefix doubling; only suffixes that still tie are sorted again.

    A suffix that ends earlier sorts first.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    ends = np.append(np.flatnonzero(first), n)
    size = np.repeat(np.diff(ends), np.diff(ends))
    open_ = np.flatnonzero(size > 1)  # places in order whose suffix isn't settled
    step = 1
    while len(open_):
        at = order[open_]
        own, after = rank[at], rank[np.minimum(at + step, n)]
        by = np.lexsort((after, own))
        at, own, after = at[by], own[by], after[by]
        order[open_] = at
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        group = np.concatenate([[True], own[1:] != own[:-1]])
        line = np.arange(len(at))
        since = np.maximum.accumulate(np.where(fresh, line, 0)) - np.maximum.accumulate(np.where(group, line, 0))
        rank[at] = own + since
        ends = np.append(np.flatnonzero(fresh), len(at))
        size = np.repeat(np.diff(ends), np.diff(ends))
        open_ = open_[size > 1]
        step *= 2
    return order


class Bits:
    """Bit vector with rank by block counts and popcount."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).tobytes(), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet tree, level by level (each level holds one bit of every symbol, zeros first)."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            one = (text >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(one), int(len(text) - one.sum())))
            text = np.concatenate([text[~one], text[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i."""
        low = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = symbol >> shift & 1 == 1
            a, b = bits.rank1(low), bits.rank1(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and how often each stands before its position."""
        symbol, low = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << shift
            a, b = bits.rank1(low), bits.rank1(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return symbol, i - low


class FMIndex:
    """Index of runs of symbols 1..symbols; runs are joined by the separator 0, which no phrase has."""

    SAMPLE = 16

    def __init__(self, runs: list[np.ndarray], symbols: int):
        size = np.array([len(r) for r in runs], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        n = int((size + 1).sum())
        text = np.zeros(n, np.int64)
        for at, run in zip(self.start.tolist(), runs, strict=True):
            text[at : at + len(run)] = run
        ends = self.start + size
        unequal = text + len(runs)  # each separator sorts by its run, so no two suffixes tie
        unequal[ends] = np.arange(len(runs))
        order = suffix_array(unequal)
        self.n = n
        self.bwt = Wavelet(np.where(order > 0, text[order - 1], 0), symbols + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        sampled = np.zeros(n, bool)
        sampled[:: self.SAMPLE] = True
        sampled[self.start] = True  # the walk back never crosses a separator
        marked = sampled[order]
        self.marked = Bits(marked)
        self.sample = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases, a matrix with a phrase in each row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.below[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.bwt.rank(symbol, high[live])
            gone = low[live] >= high[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out, at, live, steps = np.empty(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows)), 0
        while len(live):
            hit = self.marked.get(at)
            out[live[hit]] = self.sample[self.marked.rank1(at[hit])] + steps
            live, at = live[~hit], at[~hit]
            symbol, before = self.bwt.access(at)
            at = self.below[symbol] + before
            steps += 1
        return out
