"""An FM-index over integer symbols: suffix array, wavelet-tree ranks, samples.

Symbol 0 separates runs; a phrase never holds it.  Separators are unique and
ordered by position, so every suffix is distinct and the last-to-first mapping is
exact for all other symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; only groups that are still tied are sorted again."""
    n = len(s)
    separators = s == 0
    k = int(separators.sum())
    first = np.where(separators, np.cumsum(separators) - 1, s.astype(np.int64) + k)
    order = np.argsort(first, kind="stable")
    rank = _ranks(first[order], order, np.empty(n, np.int64), 0)
    step = 1
    tied = _tied(rank, order)
    while len(tied):
        key = (rank[tied].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(tied + step, n - 1)].astype(np.uint64)
        by = np.argsort(key)
        key, moved = key[by], tied[by]
        group = (key >> np.uint64(32)).astype(np.int64)
        start = np.ones(len(group), bool)
        start[1:] = group[1:] != group[:-1]
        within = np.arange(len(group)) - np.maximum.accumulate(np.where(start, np.arange(len(group)), 0))
        order[group + within] = moved
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = group + within
        rank[moved] = at[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        counts = np.diff(np.append(np.flatnonzero(new), len(key)))
        tied = moved[np.repeat(counts > 1, counts)]
        step *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray, rank: np.ndarray, base: int) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    rank[order] = base + np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    counts = np.bincount(rank, minlength=len(rank))
    return order[counts[rank[order]] > 1]


class WaveletTree:
    """Ranks of symbols in a sequence, level by level (a wavelet matrix)."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.n, self.levels = len(s), []
        for level in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            ones = int(before[-1])
            self.levels.append((level, packed, before, self.n - ones))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(i)
        for level, packed, before, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            out = []
            for x in (i, begin):
                block = x >> 6
                mask = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
                ones = before[block] + np.bitwise_count(packed[block] & mask)
                out.append(np.where(bit, zeros + ones, x - ones))
            i, begin = out
        return i - begin


class FMIndex:
    """Backward search and location of phrases in a text of symbols.

    The text begins and ends with the separator 0.  Every ``rate``-th position
    and every start of a run has its suffix position kept.
    """

    def __init__(self, s: np.ndarray, n_symbols: int, rate: int = 16):
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.tree = WaveletTree(self.bwt, n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols + 1))])
        kept = (sa % rate == 0) | (self.bwt == 0)
        self.kept, self.place = kept, np.cumsum(kept) - 1
        self.samples = sa[kept]

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of equal length) that occur: their numbers, and low and high rows."""
        # Phrases with a symbol that the text lacks go before any step.
        present = np.diff(self.first) > 0
        which = np.flatnonzero(present[phrases[:, -1]])
        for j in range(phrases.shape[1] - 2, -1, -1):
            which = which[present[phrases[which, j]]]
        last = phrases[which, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            symbol = phrases[which, j]
            low, high = self._back(symbol, low), self._back(symbol, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the nearest sampled suffix."""
        out = np.empty(len(rows), np.int64)
        which, steps = np.arange(len(rows)), 0
        while len(which):
            done = self.kept[rows]
            out[which[done]] = self.samples[self.place[rows[done]]] + steps
            which, rows = which[~done], rows[~done]
            rows = self._back(self.bwt[rows], rows)
            steps += 1
        return out
