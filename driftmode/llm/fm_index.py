"""FM-index over a sequence of word ids: suffix order, wavelet-tree ranks, sampled positions.

The index answers "where does this run of words occur" by backward search. Nothing but the
wavelet levels, the symbol counts and every ``SAMPLE``-th suffix position is kept.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(seq: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Suffix array of non-negative ids by prefix multiplication: every round sorts by two or three
    known ranks at once and only touches suffixes whose rank is still shared. The sequence must end
    in a symbol that occurs once, as documents end in separators of their own. With ``symbols`` suffixes
    are told apart by so many symbols at least, not necessarily by more."""
    n = len(seq)
    if n < 2:
        return np.arange(n)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    bits = int(n + 1).bit_length()
    step = 3 if 3 * bits <= 63 else 2
    order = np.arange(n)
    rows = np.arange(n)
    depth = 1
    padded = np.zeros(n + 1, np.int64)
    while True:
        padded[:n] = rank
        key = padded[order]
        for k in range(1, step):
            key = (key << bits) | padded[np.minimum(order + k * depth, n)]
        by = np.argsort(key)
        order, key = order[by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank[order] = head + 1
        alone = new.copy()
        alone[:-1] &= new[1:]
        if depth == 1:
            result = np.empty(n, np.int64)
        result[rows] = order
        order, rows = order[~alone], rows[~alone]
        depth *= step
        if not len(order) or (symbols is not None and depth >= symbols):
            return result


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level, 64-bit words with running counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.planes, self.before, self.zeros = [], [], []
        cur = seq
        for b in range(bits - 1, -1, -1):
            one = (cur >> b) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            plane = np.zeros(self.n // 64 + 1, "<u8")
            plane.view(np.uint8)[: len(packed)] = packed
            count = np.zeros(len(plane) + 1, np.int64)
            np.cumsum(np.bitwise_count(plane), out=count[1:])
            self.planes.append(plane)
            self.before.append(count)
            self.zeros.append(self.n - int(count[-1]))
            cur = np.concatenate((cur[~one], cur[one]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.planes[level][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``i``."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.bits):
            plane = self.planes[level][i >> 6]
            one = (plane >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self._ones(level, i)
            out = (out << 1) | one
            i = np.where(one, self.zeros[level] + a, i - a)
        return out


class FMIndex:
    """Index of documents given as word hashes with row offsets.

    Every document ends in a separator of its own, so no match leaves a document.
    """

    def __init__(self, hashes: np.ndarray, off: np.ndarray):
        docs = len(off) - 1
        self.off = off
        self.dictionary, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes) + docs
        seq = np.empty(n, np.int64)
        at = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(off))
        seq[at] = ids + docs
        sep = off[1:] + np.arange(docs)
        seq[sep] = np.arange(docs)
        self.docs, self.n = docs, n
        order = suffix_order(seq)
        symbols = docs + len(self.dictionary)
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols), out=self.first[1:])
        self.tree = WaveletMatrix(seq[order - 1], max(1, int(symbols).bit_length()))
        kept = order % SAMPLE == 0
        self.marked = np.zeros(n // 64 + 1, "<u8")
        packed = np.packbits(kept, bitorder="little")
        self.marked.view(np.uint8)[: len(packed)] = packed
        self.marks_before = np.zeros(len(self.marked) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marked), out=self.marks_before[1:])
        self.samples = order[kept]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for those that the documents do not hold."""
        if not len(self.dictionary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.dictionary, hashes), len(self.dictionary) - 1)
        return np.where(self.dictionary[at] == hashes, at + self.docs, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (rows of ids); their half-open ranges of suffixes."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.flatnonzero((phrases >= 0).all(axis=1))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            if k == phrases.shape[1] - 1:
                a, b = self.first[c], self.first[c + 1]
            else:
                a = self.first[c] + self.tree.rank(c, lo[live])
                b = self.first[c] + self.tree.rank(c, hi[live])
            lo[live], hi[live] = a, b
            lo[live[a >= b]] = hi[live[a >= b]] = 0
            live = live[a < b]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word places (counted over all documents, separators left out) of suffixes, by walking back to a sampled one."""
        place, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        left, cur = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            word = self.marked[cur >> 6]
            bit = (cur & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            mask = (np.uint64(1) << bit[hit]) - np.uint64(1)
            at = self.marks_before[cur[hit] >> 6] + np.bitwise_count(word[hit] & mask)
            place[left[hit]] = self.samples[at] + steps[left[hit]]
            left, cur = left[~hit], cur[~hit]
            if len(left):
                c = self.tree.access(cur)
                cur = self.first[c] + self.tree.rank(c, cur)
                steps[left] += 1
        sep = self.off[1:] + np.arange(self.docs)
        return place - np.searchsorted(sep, place, side="left")
