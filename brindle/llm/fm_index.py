"""An FM-index over the words of a shard, in numpy.

Symbols are small integers; 0 ends a run of symbols (a document's end, or a word that no phrase has)
and no phrase holds it. Suffixes are sorted by their symbols up to the next 0, then by place, so no two
are equal. The Burrows-Wheeler transform is kept in a wavelet matrix: one row of bits a level with
running counts, which answers rank and access in as many steps as a symbol has bits. Places of suffixes
are kept for every ``sample``-th place and for those after a 0; others are found by stepping back.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. ``symbols`` ends with 0."""
    n = len(symbols)
    places = np.flatnonzero(symbols)
    zeros = np.flatnonzero(symbols == 0)
    end = zeros[np.searchsorted(zeros, places)]  # where each suffix's run ends
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(len(places), "i8")
    for k in range(width):
        at = places + k
        key = (key << bits) | np.where(at < end, symbols[np.minimum(at, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    # rank[place]: the position among all suffixes, or that of the first equal one while undecided
    rank = np.zeros(n, "i8")
    rank[zeros] = np.arange(len(zeros))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    short = end[order] - places[order] < width  # these end inside the key: place decides
    order = places[order]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank[order] = len(zeros) + np.where(short, np.arange(len(order)), first)
    open_ = ~short & (~new | ~np.r_[new[1:], True]) if len(new) else new
    while open_.any():
        at = np.flatnonzero(open_)
        group, own = rank[order[at]], order[at]
        then = rank[own + width]
        by = np.lexsort((then, group))
        own, group, then = own[by], group[by], then[by]
        order[at] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[own] = len(zeros) + at[first]
        open_[at] = ~new | ~np.r_[new[1:], True]
        width *= 2
    return np.concatenate([zeros, order])


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, (sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []  # of each level: ones before each place
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype="i4")]).astype("i4"))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        # where each symbol's run begins after the last level
        every = np.arange(1 << self.bits)
        self.base = self._down(every, np.zeros(len(every), "i8"))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[place]
            place = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + up, place - up)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each place."""
        return self._down(symbol, place) - self.base[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how many like it stand before."""
        symbol = np.zeros(len(place), "i8")
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[place]
            bit = ones[place + 1] - up
            symbol = (symbol << 1) | bit
            place = np.where(bit, zeros + up, place - up)
        return symbol, place - self.base[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        """symbols: integers under sigma, the last 0."""
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.n = len(symbols)
        self.matrix = WaveletMatrix(before, sigma)
        kept = (order % sample == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept, dtype="i4")])
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (a row each): the range of suffixes that begin with each."""
        last = phrases[:, -1]
        low, high = self.matrix.start[last].copy(), self.matrix.start[last + 1].copy()
        for k in range(phrases.shape[1] - 2, -1, -1):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            symbol = phrases[alive, k]
            start = self.matrix.start[symbol]
            low[alive] = start + self.matrix.rank(symbol, low[alive])
            high[alive] = start + self.matrix.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, place) of every suffix in the ranges."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        place = np.zeros(len(row), "i8")
        going, steps = np.arange(len(row)), 0
        while len(going):
            at = row[going]
            kept = self.kept[at + 1] > self.kept[at]
            place[going[kept]] = self.places[self.kept[at[kept]]] + steps
            going, at = going[~kept], at[~kept]
            if len(going):
                symbol, nth = self.matrix.access(at)
                row[going] = self.matrix.start[symbol] + nth
            steps += 1
        return which, place
