"""Elias-Fano coded levels of an n-gram trie, queried for whole arrays at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Place of the k-th one in a byte.
_SELECT = np.array([[[j for j in range(8) if i >> j & 1][k] if k < bin(i).count("1") else 0 for k in range(8)] for i in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Place of the k-th (from 0) one or zero. before: how many stand before each word."""
    w = np.searchsorted(before, k, "right") - 1
    left = (k - before[w]).astype(np.uint8)
    word = words[w] if ones else ~words[w]
    place = np.zeros(len(k), U)
    for width in (32, 16, 8):
        n = np.bitwise_count(word & U((1 << width) - 1))
        on = left >= n
        left -= n * on
        word >>= on * U(width)
        place += on * U(width)
    return w * 64 + place.astype(np.int64) + _SELECT[(word & U(255)).astype(np.int64), left]


class Sequence:
    """A monotone sequence: low bits as they are, high bits in unary."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray):
        self.n, self.shift, self.low, self.high = n, shift, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(high)) * 64 - self.ones

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(header, low, high) of values that don't fall; low bits take 0, 8, 16 or 32 bits each."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        want = max(0, (top // max(1, n)).bit_length() - 1)
        shift = min((x for x in (0, 8, 16, 32)), key=lambda x: n * x + (top >> x) + n if (top >> x) <= 64 * max(64, n) else 1 << 60) if want else 0
        low = (values & ((1 << shift) - 1)).astype({0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}[shift]) if shift else np.zeros(0, np.uint8)
        place = (values >> shift) + np.arange(n)
        bits = np.zeros(((top >> shift) + n + 64) // 64 * 64 + 64, np.uint8)
        bits[place] = 1
        return np.array([n, shift]), low, np.packbits(bits, bitorder="little").view(U)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, i, True) - i
        return (high << self.shift | self.low[i].astype(np.int64)) if self.shift else high

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first element that is at least x (n where there is none), and whether it is x."""
        high, low = x >> self.shift, x & ((1 << self.shift) - 1)
        last = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))
        beyond = high > last - 1
        high = np.minimum(high, last - 1)
        i = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), False) + 1 - high, 0)
        stop = _select(self.high, self.zeros, high, False) - high
        if self.shift:  # among the elements with the same high bits, by halves
            todo = np.flatnonzero(i < stop)
            lo, hi, want = i[todo], stop[todo], low[todo]
            while len(todo):
                mid = (lo + hi) >> 1
                less = self.low[mid] < want
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
                more = lo < hi
                i[todo[~more]] = lo[~more]
                todo, lo, hi, want = todo[more], lo[more], hi[more], want[more]
        same = ~beyond & (i < stop)
        if self.shift:
            same[same] = self.low[i[same]] == low[same]
        i[beyond] = self.n
        return i, same


class Level:
    """Children of a level's nodes: begin of each node's children, and their words, made monotone by adding what the earlier nodes' children end with."""

    def __init__(self, begin: Sequence, words: Sequence):
        self.begin, self.words = begin, words

    @staticmethod
    def arrays(parent: np.ndarray, word: np.ndarray, nodes: int) -> dict[str, np.ndarray]:
        """parent, word: sorted."""
        counts = np.bincount(parent, minlength=nodes)
        begin = np.concatenate([[0], np.cumsum(counts)])
        last = np.zeros(nodes, np.int64)
        full = counts > 0
        last[full] = word[begin[1:][full] - 1] + 1
        base = np.cumsum(last) - last
        out = {}
        for name, values in (("begin", begin), ("words", base[parent] + word + 1)):
            out |= dict(zip((f"{name}_head", f"{name}_low", f"{name}_high"), Sequence.arrays(values.astype(np.int64)), strict=True))
        return out

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> Level:
        return Level(*(Sequence(int(arrays[f"{x}_head"][0]), int(arrays[f"{x}_head"][1]), arrays[f"{x}_low"], arrays[f"{x}_high"]) for x in ("begin", "words")))

    def child(self, node: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of the child of node[at] with that word, or -1: the successor, among the node's children, of the word counted from where the earlier nodes' words end. Pointers are decoded once a node."""
        out = np.full(len(word), -1, np.int64)
        if not len(word) or not self.words.n:
            return out
        lo, hi = self.begin.get(node), self.begin.get(node + 1)
        base = np.zeros(len(node), np.int64)
        later = np.flatnonzero(lo > 0)
        base[later] = self.words.get(lo[later] - 1)
        lo, hi, base = lo[at], hi[at], base[at]
        q = np.flatnonzero(hi > lo)
        i, same = self.words.find(base[q] + word[q] + 1)
        same &= (i < hi[q]) & (i >= lo[q])
        out[q[same]] = i[same]
        return out
