"""An FM-index over integer symbols: wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (rounded up to a power of two), by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width, order = 1, None
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if rank.max() == n:
            break
    return order if order is not None else np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Rank of any symbol in one bit array a level: 64-bit words with a running count before each."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view("<u8")
            count = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append((np.cumsum(count) - count).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place``, plus the start of its run in the last level (cancelled by ``origin``)."""
        for i in range(self.levels):
            word = place >> 6
            ones = self.before[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> (self.levels - 1 - i)) & 1
            place = np.where(up == 1, self.zeros[i] + ones, place - ones)
        return place


class FMIndex:
    """Counts weighted occurrences of patterns of at most ``depth`` symbols.  Symbols are 1 and up; 0 separates texts."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        order = sorted_suffixes(text, depth)
        self.matrix = WaveletMatrix(text[order - 1])  # the symbol before each suffix
        count = np.bincount(text)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.origin = self.matrix.rank(np.arange(len(count)), np.zeros(len(count), np.int64))
        self.total = np.concatenate([[0], np.cumsum(weight[order])])

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` put before the patterns of these intervals."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        n, base = len(symbol), self.first[symbol] - self.origin[symbol]
        return base + both[:n], base + both[n:]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.total[high] - self.total[low]


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, longest: int, least: int = 2) -> np.ndarray:
    """For each place in ``ends``: how many symbols up to and with it, at most ``longest``, form a pattern of ``least`` or more occurrences.

    All places search backward in step; a place drops out where its count falls below ``least``.
    """
    out = np.zeros(len(ends), np.int64)
    live = np.arange(len(ends))
    low, high = index.start(text[ends])
    for length in range(1, longest + 1):
        good = index.occurrences(low, high) >= least
        live, low, high = live[good], low[good], high[good]
        out[live] = length
        if length == longest or not len(live):
            break
        before = ends[live] - length
        inside = before >= 0
        live, low, high, before = live[inside], low[inside], high[inside], before[inside]
        inside = text[before] > 0
        live, low, high, before = live[inside], low[inside], high[inside], before[inside]
        low, high = index.extend(text[before], low, high)
    return out
