"""An FM-index over a sequence of small integers, in numpy.

Built per shard of training text by ``decontamination``. All patterns of a
length are searched together, one backward step for all that still match.
"""

from __future__ import annotations

import numpy as np

#: Every text position that is a multiple of this keeps its suffix position.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers of at least 0) in order, by prefix doubling.

    A suffix that ends first sorts first. The first round sorts by as many symbols
    as fit into 62 bits; only suffixes that still tie are sorted again in later rounds.
    """
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= text[k:] + 1
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    ties = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(ties):
        at = order[ties]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[ties], key = at[again], key[again]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(fresh)
        rank[order[ties]] = ties[heads][np.cumsum(fresh) - 1]
        sizes = np.diff(np.append(heads, len(ties)))
        ties = ties[np.repeat(sizes, sizes) > 1]
        width *= 2
    return order


class WaveletTree:
    """Rank and access over an integer sequence: one bit vector for each bit of the symbols.

    The levels are stored one after another over the whole sequence, zeros
    first, as in the wavelet matrix of Claude and Navarro (2012).
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros, self.ones = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32)), dtype=np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        starts, ends = np.zeros_like(ends), ends.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbols >> level & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[starts], ones[ends]
            starts = np.where(bit, zeros + a, starts - a)
            ends = np.where(bit, zeros + b, ends - b)
        return ends - starts

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            at = np.where(bit == 1, zeros + before, at - before)
            out = out << 1 | bit
        return out


class FMIndex:
    """Backward search and location over ``text`` (integers of at least 1)."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)  # the end sorts before all else
        order = suffix_order(text)
        last = text[order - 1]
        top = int(text.max())
        self.tree = WaveletTree(last, max(1, top.bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        kept = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.samples = order[kept]
        self.n = len(text)
        self.top = top

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with each pattern (all of one length): from, to."""
        count, length = patterns.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        alive = np.flatnonzero((patterns <= self.top).all(axis=1))
        low[:], high[alive] = 0, self.n
        high[np.setdiff1d(np.arange(count), alive)] = 0
        for k in range(length - 1, -1, -1):
            symbols = patterns[alive, k]
            base = self.before[symbols]
            low[alive] = base + self.tree.rank(symbols, low[alive])
            high[alive] = base + self.tree.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            at = self.kept[rows]
            hit = self.kept[rows + 1] > at
            out[todo[hit]] = self.samples[at[hit]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbols = self.tree.access(rows)
            rows = self.before[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return out
