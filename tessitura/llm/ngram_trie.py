"""A compact n-gram trie: Elias-Fano levels with quantised values.

Level k holds the k-grams in sorted order.  Per level three arrays, all in one
memory map: the Elias-Fano coded pointers (monotone) from the level above to
the range of successors, the Elias-Fano coded successor ids (made monotone by
adding, per range, a multiple of the id universe), and one byte per n-gram that
points into a codebook of values.
"""

from __future__ import annotations

import mmap

import numpy as np


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, dtype=np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if self.n else 0) + self.n + 1, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits)
        self.n_high = len(bits)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if self.low_bits <= np.iinfo(t).bits)
        self.low = (values & np.uint64((1 << self.low_bits) - 1)).astype(kind)
        self._starts: np.ndarray | None = None

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.n_high))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self.low.astype(np.uint64)

    def bucket_starts(self) -> np.ndarray:
        """First position of every high part, and the end."""
        if self._starts is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, count=self.n_high) == 0)
            self._starts = np.concatenate([[0], zeros - np.arange(len(zeros)), [self.n]]).astype(np.int64)
        return self._starts

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted value, or -1: a binary search inside its high part."""
        wanted = np.asarray(wanted, dtype=np.uint64)
        starts = self.bucket_starts()
        high = np.minimum((wanted >> np.uint64(self.low_bits)).astype(np.int64), len(starts) - 2)
        at, end = starts[high], starts[high + 1]
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        over = (wanted >> np.uint64(self.low_bits)).astype(np.int64) != high
        out = np.full(len(wanted), -1, dtype=np.int64)
        left = np.flatnonzero((at < end) & ~over)
        lo, hi, low = at[left], end[left], low[left]
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.low[np.minimum(mid, self.n - 1)].astype(np.uint64) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        hit = (lo < end[left]) & (self.low[np.minimum(lo, self.n - 1)].astype(np.uint64) == low)
        out[left[hit]] = lo[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.high, self.low]

    def put(self, arrays: list[np.ndarray]) -> None:
        self.high, self.low = arrays


class Quantiser:
    """Up to 256 values by quantiles of the sorted distinct values; each value becomes one byte."""

    def __init__(self, values: np.ndarray):
        distinct = np.unique(values) if len(values) else np.zeros(1)
        if len(distinct) > 256:
            edges = np.linspace(0, len(distinct), 257).astype(np.int64)
            self.book = np.add.reduceat(distinct, edges[:-1]) / np.diff(edges)
            self.cuts = distinct[edges[1:-1]]
        else:
            self.book, self.cuts = distinct, distinct[1:]

    def encode(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, values, side="right").astype(np.uint8)


class NGramTrie:
    """Sorted distinct n-grams of one order and their prefixes; values per order are log10 and quantised."""

    def __init__(self, grams: np.ndarray, values: list[np.ndarray | None], universe: int):
        """``grams``: (m, order) ids in lexicographic order, distinct; ``values[k]``: one log value per distinct (k+1)-gram, or None."""
        self.universe = universe
        self.order = grams.shape[1]
        self.pointers: list[EliasFano | None] = []
        self.ids: list[EliasFano] = []
        self.codes: list[np.ndarray | None] = []
        self.books: list[np.ndarray | None] = []
        above = np.zeros(len(grams), dtype=np.int64)  # number of each n-gram's prefix in the level above
        n_above = 1
        new = np.zeros(len(grams), dtype=bool)
        for k in range(self.order):
            fresh = np.ones(len(grams), dtype=bool)
            fresh[1:] = grams[1:, k] != grams[:-1, k]
            new = new | fresh
            rows = np.flatnonzero(new)
            parent = above[rows]
            self.ids.append(EliasFano(parent.astype(np.uint64) * np.uint64(universe) + grams[rows, k].astype(np.uint64)))
            self.pointers.append(EliasFano(np.searchsorted(parent, np.arange(n_above + 1))))
            v = values[k]
            quant = Quantiser(v) if v is not None else None
            self.codes.append(quant.encode(v) if quant else None)
            self.books.append(quant.book if quant else None)
            above = np.cumsum(new) - 1
            n_above = len(rows)
        self._map()

    def _map(self) -> None:
        """Move all levels into one anonymous memory map."""
        holders = [*self.ids, *[p for p in self.pointers if p is not None]]
        pieces = [a for h in holders for a in h.arrays()] + [c for c in self.codes if c is not None]
        size = sum(-(-a.nbytes // 8) * 8 for a in pieces)
        self.memory = mmap.mmap(-1, max(size, 8))
        moved, at = [], 0
        for a in pieces:
            view = np.frombuffer(self.memory, dtype=a.dtype, count=len(a), offset=at)
            view[:] = a
            moved.append(view)
            at += -(-a.nbytes // 8) * 8
        for h in holders:
            h.put([moved.pop(0), moved.pop(0)])
        self.codes = [moved.pop(0) if c is not None else None for c in self.codes]

    @property
    def nbytes(self) -> int:
        return len(self.memory)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Number of each n-gram in its level, or -1: walks down, searching each id relative to its context's range."""
        node = np.zeros(len(grams), dtype=np.int64)
        for k in range(grams.shape[1]):
            ok = np.flatnonzero((node >= 0) & (grams[:, k] < self.universe))
            found = np.full(len(grams), -1, dtype=np.int64)
            found[ok] = self.ids[k].find(node[ok].astype(np.uint64) * np.uint64(self.universe) + grams[ok, k].astype(np.uint64))
            node = found
        return node

    def successors(self, context: np.ndarray) -> np.ndarray:
        """Ids that follow one context (a 1-d array of ids), by the pointers of its level."""
        node = self.find(context[None, :])[0] if len(context) else 0
        if node < 0:
            return np.zeros(0, dtype=np.int64)
        lo, hi = self.pointers[len(context)].decode()[node : node + 2].astype(np.int64)
        return (self.ids[len(context)].decode()[lo:hi] - np.uint64(node * self.universe)).astype(np.int64)

    def value(self, grams: np.ndarray, missing: float) -> np.ndarray:
        """Quantised value of each n-gram, ``missing`` where the trie has none."""
        at = self.find(grams)
        level = grams.shape[1] - 1
        out = np.full(len(grams), missing)
        out[at >= 0] = self.books[level][self.codes[level][at[at >= 0]]]
        return out
