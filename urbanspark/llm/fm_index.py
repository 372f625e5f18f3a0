"""An FM-index over integer symbols: suffix sorting, a wavelet matrix for ranks, sampled suffix positions.

The text is a row of segments, each ended by the symbol 0; patterns hold no 0, so no match crosses segments.
Equal suffixes are in the order of their places. All steps work on whole arrays of rows at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions a suffix's place is kept; the begin of each segment is kept as well.
SAMPLE = 16


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet tree in matrix form: one bit vector a level, the zeros of a level before its ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        begin, x = np.arange(1 << self.depth, dtype=np.int64) * 0, symbols
        every = np.arange(1 << self.depth)
        for shift in range(self.depth - 1, -1, -1):
            bit = (x >> shift) & 1
            level, zeros = Bits(bit.astype(np.uint8)), int(len(x) - bit.sum())
            self.levels.append((level, zeros))
            begin = self._down(level, zeros, begin, (every >> shift) & 1 == 1)
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        #: Where each symbol's block begins on the lowest level.
        self.begin = begin

    @staticmethod
    def _down(level: Bits, zeros: int, i: np.ndarray, one: np.ndarray) -> np.ndarray:
        r = level.rank(i)
        return np.where(one, zeros + r, i - r)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i ones."""
        for k, (level, zeros) in enumerate(self.levels):
            i = self._down(level, zeros, i, (symbol >> (self.depth - 1 - k)) & 1 == 1)
        return i - self.begin[symbol]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in self.levels:
            one = level[i]
            symbol = symbol << 1 | one
            i = self._down(level, zeros, i, one)
        return symbol, i - self.begin[symbol]


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes of ``text`` (it ends with 0): prefix doubling, only ties are sorted again."""
    n, width = len(text), max(1, int(sigma - 1).bit_length())
    h = max(1, 62 // width)
    key, ended = text.astype(np.int64), text == 0
    first = key.copy()
    for j in range(1, h):
        after = np.concatenate([key[1:], [0]])
        after[ended] = 0  # nothing counts after a segment's end
        key = first << (width * j) | after
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    new |= (ordered & ((1 << width) - 1)) == 0  # ended within the key: by place
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))  # rows that share their rank
        if not len(tied):
            return order
        at = order[tied]
        group, then = rank[at], rank[at + h]
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[tied] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        new[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2


class FMIndex:
    """Counts and finds rows of symbols in ``text``, whose segments end with 0; symbols are below ``sigma``."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_order(text, sigma)
        last = text[order - 1]
        last[order == 0] = 0
        self.n = len(text)
        self.wavelet = Wavelet(last, sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        kept = (order % sample == 0) | (last == 0)
        self.kept, self.places = Bits(kept.astype(np.uint8)), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of every pattern (a row, filled up with 0 on the right): where its rows begin and end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > j) & (low < high))
            c = patterns[on, j].astype(np.int64)
            low[on] = self.smaller[c] + self.wavelet.rank(c, low[on])
            high[on] = self.smaller[c] + self.wavelet.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in these rows: steps to the left until a kept one."""
        out, todo, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(todo):
            known = self.kept[row]
            out[todo[known]] = self.places[self.kept.rank(row[known])] + steps
            todo, row = todo[~known], row[~known]
            symbol, before = self.wavelet.read(row)
            row, steps = self.smaller[symbol] + before, steps + 1
        return out
