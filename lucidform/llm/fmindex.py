"""A compressed full-text index over word codes: backward search in a wavelet matrix of the Burrows-Wheeler transform.

The indexed text is a list of segments, each closed by a terminator of its own, so suffixes are told apart at a
segment's end at the latest and no match reaches over one.  The index keeps the transform as packed bits with counts
every 64 of them, one level a bit of the symbol, and two marks per suffix: where the prefix of ``window`` symbols (of
``window - 1``) differs from the suffix before.  With these, backward search slides: the range of a window shrinks to
its first ``window - 1`` symbols and grows by the symbol to the left, one step a position instead of ``window``.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed 64 to a word, ones counted up to each word."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, dtype=bool)]), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class Wavelet:
    """A sequence of small integers as one bit vector for each bit, highest first, zeros moved before ones."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels, self.zeros, now = [], [], symbols
        self.shifts = list(range(max(1, int(most).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bit = (now >> shift & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(most + 1)
        self.origin = np.zeros(most + 1, dtype=np.int64)
        self.origin = self._down(every, np.zeros(most + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, shift in zip(self.levels, self.zeros, self.shifts):
            one = level.ones(i)
            i = np.where(symbol >> shift & 1, zeros + one, i - one)
        return i

    def count(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before position i."""
        return self._down(symbol, i) - self.origin[symbol]


def suffixes(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes by prefix doubling, and for each of them in order whether its first ``window`` (and
    ``window - 1``) symbols differ from those of the one before.  Zeros are terminators, all different."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    kept, depth = {}, 1
    while True:
        kept[depth] = rank
        later = np.zeros(n, dtype=np.int64)
        later[: n - depth] = rank[depth:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        depth *= 2
        if rank[order[-1]] == n - 1:
            break
    kept[depth] = rank

    def differs(length: int) -> np.ndarray:
        out = np.ones(n, dtype=bool)
        if length >= depth:  # all suffixes differ by then
            return out
        same, at = np.ones(n - 1, dtype=bool), 0
        for p in (1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1):
            shifted = np.concatenate([kept[p][at:], -1 - np.arange(min(at, n))])  # beyond the end all differ
            same &= shifted[order[1:]] == shifted[order[:-1]]
            at += p
        out[1:] = ~same
        return out

    return order, differs(window), differs(window - 1)


class FmIndex:
    """Segments of symbols 1, 2, ... (``bounds`` in ``symbols``) with the earliest of each window's places.

    ``place`` is a number for each symbol of the segments: of windows with equal symbols the least place of a first
    symbol is kept, so a match is told from an earlier one without locating it.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, place: np.ndarray, window: int):
        lengths = np.diff(bounds)
        text = np.zeros(len(symbols) + len(lengths), dtype=np.int64)
        own = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        text[own] = symbols
        places = np.full(len(text), np.iinfo(np.int64).max)
        places[own] = place
        order, differ, shorter = suffixes(text, window)
        self.window, self.size, self.most = window, len(text), int(symbols.max(initial=0))
        self.transform = Wavelet(text[order - 1], self.most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.most + 1))])
        self.groups, self.runs = Bits(differ), Bits(shorter)
        self.run_starts = np.append(np.flatnonzero(shorter), len(text))
        self.earliest = np.minimum.reduceat(places[order], np.flatnonzero(differ))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with a symbol put before them; unknown symbols (0) give empty ranges."""
        base = self.first[symbol]
        low, high = base + self.transform.count(symbol, low), base + self.transform.count(symbol, high)
        return low, np.where(symbol == 0, low, high)

    def match(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each position of the streamed segments, the earliest indexed place at which its window stands too, or
        -1.  A run of n matched positions is a match of n + window - 1 symbols.  Symbols that aren't indexed are 0."""
        w = self.window
        out = np.full(len(symbols), -1, dtype=np.int64)
        lane = np.flatnonzero(np.diff(bounds) >= w)
        end, start = bounds[1:][lane].copy(), bounds[:-1][lane]
        length, low, high = np.zeros(len(lane), dtype=np.int64), np.zeros(len(lane), dtype=np.int64), np.full(len(lane), self.size)
        while len(lane):
            full = length == w
            if full.any():  # shrink to the first w - 1 symbols
                run = self.runs.ones(low[full] + 1) - 1
                low[full], high[full] = self.run_starts[run], self.run_starts[run + 1]
                end[full] -= 1
                length[full] = w - 1
            going = end - start >= w
            if not going.all():
                lane, end, start, length, low, high = (a[going] for a in (lane, end, start, length, low, high))
                if not len(lane):
                    break
            low, high = self.extend(symbols[end - length - 1], low, high)
            hit = low < high
            length = np.where(hit, length + 1, 0)
            end = np.where(hit, end, end - 1)
            low, high = np.where(hit, low, 0), np.where(hit, high, self.size)
            whole = length == w
            out[end[whole] - w] = self.earliest[self.groups.ones(low[whole] + 1) - 1]
        return out
