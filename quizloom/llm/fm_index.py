"""FM-index of a sequence of symbols: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbol a level (levels are stored whole, so
    that all nodes of a level share one row of counts)."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self._ones, self._zeros = [], []
        row = symbols.astype(np.int64)
        for shift in range(self.depth - 1, -1, -1):
            bits = (row >> shift) & 1
            self._ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self._zeros.append(len(row) - int(bits.sum()))
            row = np.concatenate([row[bits == 0], row[bits == 1]])

    def _down(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self._ones[level][at]
        return np.where(bit, self._zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``end``."""
        start = np.zeros_like(end)
        for level in range(self.depth):
            bit = (symbol >> (self.depth - 1 - level)) & 1
            start, end = self._down(level, bit, start), self._down(level, bit, end)
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.depth):
            bit = (self._ones[level][at + 1] - self._ones[level][at]).astype(np.int64)
            symbol = symbol << 1 | bit
            start, at = self._down(level, bit, start), self._down(level, bit, at)
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Symbol 0 is an end: each stands for a symbol of
    its own, smaller than all others and ordered by place. The last symbol has to be 0."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - step)] = rank[step:] + 1
        key = rank * np.int64(max(n, int(rank.max()) + 1) + 2) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of runs of symbols from 1 to ``top``, each run closed by a 0.

    Positions are sampled at every ``sample``-th place of a run, its first included, so a walk
    back to a sampled place never leaves its run.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        order = suffix_array(text)
        self.length = len(text)
        self._tree = WaveletTree(text[order - 1], top)
        self._first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        closes = np.flatnonzero(text == 0)
        starts = np.concatenate([[0], closes[:-1] + 1])
        inside = np.arange(len(text)) - np.repeat(starts, closes - starts + 1)
        self._sampled = (inside % sample == 0)[order]
        self._before = np.cumsum(self._sampled) - self._sampled
        self._positions = order[self._sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (first, last exclusive) of the suffixes that start with each phrase; ``phrases``
        has a row of symbols per phrase, of which the first ``sizes`` count."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.length, np.int64)
        for back in range(int(sizes.max(initial=0))):
            left = np.flatnonzero((back < sizes) & (low < high))
            symbol = phrases[left, sizes[left] - 1 - back]
            base = self._first[symbol]
            low[left] = base + self._tree.rank(symbol, low[left])
            high[left] = base + self._tree.rank(symbol, high[left])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        position, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            hit = self._sampled[at]
            done = open_[hit]
            position[done] = self._positions[self._before[at[hit]]] + steps[done]
            open_, at = open_[~hit], at[~hit]
            symbol, rank = self._tree.symbol_and_rank(at)
            at = self._first[symbol] + rank
            steps[open_] += 1
        return position
