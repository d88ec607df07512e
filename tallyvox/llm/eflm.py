"""Language-model scoring with sharded n-gram tries in Elias-Fano code.

Words are white-space tokens, A-Z lower-cased; each text ends with an end token. Probabilities of unigrams, bigrams and
trigrams are interpolated with absolute discounting. Every bigram and trigram found LEAST times or more in the training text
is in the model, which grows with it. What is found less often goes to the back-off weights, so each context's
probabilities sum to one. Values have 8 bits each.

 1. Words are counted, and texts written once as word numbers: the most frequent words have short ones that every task
    knows (for speed, not for results), the others stand as 64-bit hashes and get their exact counts by a join.
 2. N-grams (u, v, w) are partitioned by the word v before the last, so that a trigram and its bigram (v, w) are in one part.
    A word v with more tokens than a part is to hold is split by u; its bigrams are summed before and copied to its parts.
    One task builds a part and writes it to one file in the shared folder: a trie with v at its root, below it the u with
    their w (trigrams) and the w of v (bigrams).
 3. For scoring, a task sends its tokens, sorted, each with the place of its text, to the tasks of their parts. Many lookups
    of one part are dealt out to several tasks, which all map its file. Sums go back to the texts' own partitions, as 32-bit
    numbers: a score is exact to some 1e-7 of itself, beside the 8 bits of the model's values.

A part holds so many tokens however large the corpus is; their number grows. Very long texts are scored whole: a text is one
row of word numbers, two to eight bytes a word, until its tokens are sent to their parts.

Null and empty texts are their end token. Repeated rows are scored each on its own. A null id is training text. Without
training text every probability is 1 / (V + 1) with V = 0. Columns other than id and text aren't read, but those to be kept.
spark.checkpoint.dir must be a folder that tasks can open as files.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .eliasfano import Level
from .scratch import shared_dir, small_batches, written

U = np.uint64
#: Words that have short numbers. Other words stand as hashes, with the top bit set.
WORDS = 1 << 19
TOP, BITS = U(1 << 63), U(21)
#: Below the numbers of a part's other words. The two last are for words to be found elsewhere, and for the place before a text.
OTHER = 1 << 20
ELSEWHERE, START = U(OTHER - 2), U(OTHER - 1)
LEAST, DISCOUNT = 2, 0.75
#: Training tokens a part of the model is to hold, and tokens a task holds before it sends them on: MOST where there are so many parts that few tokens go to each.
PART_TOKENS, FLUSH, MOST = 1 << 21, 1 << 20, 1 << 23
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = np.uint64(0x5E4DE4D5E4DE4D5F)
#: Distinct keys a task counts before it sends them on.
HELD = 1 << 21


def words_of(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each document's words, and the documents' offsets."""
    low = chunk.lower()
    starts, ends, at = low.words()
    return np.insert(low.hashes(starts, ends), at[1:], END) | TOP, at + np.arange(len(at))


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, (key, c) rows."""
    held, counts, size = [], [], 0
    for chunk in tx.chunks(batches):
        k, c = np.unique(words_of(chunk)[0], return_counts=True)
        held.append(k)
        counts.append(c)
        size += len(k)
        if size > HELD:
            k, c = summed(np.concatenate(held), np.concatenate(counts))
            held, counts, size = [k], [c], len(k)
            if size > HELD // 2:
                yield tx.batch(key=tx.ints(k), c=c)
                held, counts, size = [], [], 0
    if size:
        k, c = summed(np.concatenate(held), np.concatenate(counts))
        yield tx.batch(key=tx.ints(k), c=c)


def summed(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    if not len(key):
        return key, c
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(c[order], first)


class Words:
    """Numbers of known words, by an open table."""

    def __init__(self, key: np.ndarray):
        self.size = 1 << max(4, int(len(key) * 2).bit_length())
        self.slot, self.number = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        todo, at = np.arange(len(key)), (key & np.uint64(self.size - 1)).astype(np.int64)
        while len(todo):
            free = self.slot[at[todo]] == 0
            self.slot[at[todo[free]]] = key[todo[free]]
            won = self.slot[at[todo]] == key[todo]
            self.number[at[todo[won]]] = todo[won]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (self.size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.size - 1)).astype(np.int64)
        there = self.slot[at]
        out = np.where(there == h, self.number[at], -1).astype(np.int64)
        todo = np.flatnonzero((there != h) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.size - 1)
            there = self.slot[at[todo]]
            hit = there == h[todo]
            out[todo[hit]] = self.number[at[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): 256 levels, half of them at even shares of the values, half at even steps over their range."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    book = np.unique(np.concatenate([np.quantile(x, (np.arange(128) + 0.5) / 128), np.linspace(x.min(), x.max(), 128)]))
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, x).astype(np.uint8)
    return codes, np.pad(book, (0, 256 - len(book)), mode="edge").astype(np.float32)


def squeezed(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first, compressed."""
    if not x.size:
        return b""
    raw = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def loose(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def rising(x: np.ndarray) -> bytes:
    """A sorted array, by its steps."""
    return squeezed(np.diff(x, prepend=x.dtype.type(0)))


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(loose(raw, U), dtype=U)


class Grams(NamedTuple):
    """Word triples: those of short words as one sorted key, the others as three arrays. u is START where there is none."""

    key: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[Grams, np.ndarray]:
        """The grams in their order, and the places they are from."""
        ok = (u | v | w) < TOP
        key = (v[ok] << BITS | u[ok]) << BITS | w[ok]
        order, rest = np.argsort(key), np.flatnonzero(~ok)
        return Grams(key[order], np.stack([u[rest], v[rest], w[rest]])), np.concatenate([np.flatnonzero(ok)[order], rest])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = (U(1) << BITS) - U(1)
        short = (self.key >> BITS) & low, self.key >> (BITS + BITS), self.key & low
        return tuple(np.concatenate([a, b]) for a, b in zip(short, self.rest, strict=True))

    def take(self, at: np.ndarray) -> Grams:
        """Some of them, by rising places."""
        n = int(np.searchsorted(at, len(self.key)))
        return Grams(self.key[at[:n]], self.rest[:, at[n:] - len(self.key)])

    def bytes(self) -> tuple[bytes, bytes]:
        return rising(self.key), squeezed(self.rest)

    @staticmethod
    def read(key: bytes, rest: bytes) -> Grams:
        return Grams(risen(key), loose(rest, U).reshape(3, -1))


def gathered(found: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples of arrays put together until they have at least that size."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= size:
            yield tuple(np.concatenate(y) for y in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(y) for y in zip(*held, strict=True))


class Codes:
    """Words as numbers of one part: short ones as they are, others by their place among the part's others; -1 for unknown ones."""

    def __init__(self, others: np.ndarray):
        self.others = others

    def of(self, word: np.ndarray) -> np.ndarray:
        out = word.astype(np.int64)
        q = np.flatnonzero(word >= TOP)
        if len(q):
            at = np.searchsorted(self.others, word[q])
            there = at < len(self.others)
            there[there] = self.others[at[there]] == word[q][there]
            out[q] = np.where(there, at + OTHER, -1)
        return out


def in_order(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by these columns, the first of each distinct row in that order)."""
    if max((int(c.max(initial=0)) for c in columns), default=0) >> 63 // len(columns) == 0:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key << 63 // len(columns) | c
        order = np.argsort(key)
        new = key[order][1:] != key[order][:-1]
    else:  # numbers too large for one key
        order = np.lexsort(columns[::-1])
        new = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, np.flatnonzero(np.append(True, new)) if len(order) else np.zeros(0, np.int64)


class Part:
    """A part of the model, mapped from its file. Levels: the u below a v, the w below a u below a v, the w below a v."""

    LEVELS = ("u", "uw", "w")

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = int(raw[:8].view("<u8")[0])
        self.arrays = {k: raw[a : a + n].view(kind) for k, kind, a, n in json.loads(raw[8 : 8 + head].tobytes())}
        self.root, self.codes = self.arrays["root"], Codes(self.arrays["others"])
        self.levels = {x: Level.of({k[len(x) + 1 :]: a for k, a in self.arrays.items() if k.startswith(f"{x}_")}) for x in self.LEVELS}
        self.book = {x: 10.0 ** self.arrays[f"book.{x}"].astype(float) for x in ("p3", "p2", "off3", "off2")}
        self.filter = Filter(self.arrays["filter"])

    @staticmethod
    def write(path: str, grams: tuple[np.ndarray, ...], hot: tuple[np.ndarray, ...], discount: float) -> None:
        """grams: u, v, w, c, with all of those of each v that isn't in hot; hot: v, w, c, all of each v in it. Both may have rows twice: c of grams is to be summed."""
        u, v, w, c = grams
        others = np.unique(np.concatenate([x[x >= TOP] for x in (u, v, w, *hot[:2])]))
        codes = Codes(others)
        u, v, w = codes.of(u), codes.of(v), codes.of(w)
        order, first = in_order(v, u, w)
        u, v, w, c = u[order][first], v[order][first], w[order][first], np.add.reduceat(c[order], first) if len(first) else c
        hv, hw = codes.of(hot[0]), codes.of(hot[1])
        order, first = in_order(hv, hw)
        hv, hw, hc = hv[order][first], hw[order][first], hot[2][order][first]
        two = ~np.isin(v, hv)
        order, first = in_order(v[two], w[two])
        bv, bw = (np.concatenate([x[two][order][first], y]) for x, y in ((v, hv), (w, hw)))
        bc = np.concatenate([np.add.reduceat(c[two][order], first) if len(first) else c[:0], hc])
        order = in_order(bv, bw)[0]
        bv, bw, bc = bv[order], bw[order], bc[order]

        three = u != int(START)
        u, v, w, c = u[three], v[three], w[three], c[three]
        new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])) if len(u) else np.zeros(0, bool)
        context, (keep3, parent3, p3, off3, cu, cv) = np.cumsum(new) - 1, (np.zeros(0, np.int64),) * 6
        if len(u):
            keep3, parent3, p3, off3, names = kept_of(context, c, discount)
            cu, cv = u[new][names], v[new][names]
        node2, begin2 = np.unique(bv, return_inverse=True)
        keep2, parent2, p2, off2, names2 = kept_of(begin2, bc, discount)
        root = np.unique(np.concatenate([cv, node2[names2]]))  # every v with a bigram or trigram
        a = {"others": others, "root": np.where(root < OTHER, root.astype(U), others[np.maximum(root - OTHER, 0)] if len(others) else root.astype(U))}
        at = lambda x: np.searchsorted(root, x)
        for name, parent, word, n in (("u", at(cv), cu, len(root)), ("uw", parent3, w[keep3] if len(u) else w, len(cu)), ("w", at(node2[names2][parent2]), bw[keep2], len(root))):
            a |= {f"{name}_{k}": x for k, x in Level.arrays(parent, word, n).items()}
        name = lambda x: np.where(x < OTHER, x.astype(U), others[np.maximum(x - OTHER, 0)] if len(others) else U(0))
        keep3, keep2 = keep3.astype(np.int64), keep2.astype(np.int64)
        three = Filter.mixed(name(v[keep3]), name(u[keep3])), name(w[keep3])
        a["filter"] = Filter.of([(1, name(cv), name(cu)), (2, name(bv[keep2]), name(bw[keep2])), (3, *three)])
        whole2 = np.zeros(len(root))  # no bigram: all is left to the unigrams
        whole2[at(node2[names2])] = np.log10(off2)
        for k, x in (("p3", np.log10(p3)), ("off3", np.log10(off3)), ("p2", np.log10(p2)), ("off2", whole2)):
            a[f"code.{k}"], a[f"book.{k}"] = quantised(x)
        mapped(path, a)

    def find(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p, off): what bigrams and trigrams say of w after u, v, and the weight of its unigram. Rows of one v, and of one u in it, stand together."""
        p, off = np.zeros(len(v)), np.ones(len(v))
        if not len(self.root) or not len(v):
            return p, off
        new_v = np.append(True, v[1:] != v[:-1])
        first, of_v = np.flatnonzero(new_v), np.cumsum(new_v) - 1
        node = np.minimum(np.searchsorted(self.root, v[first]), len(self.root) - 1)
        known = self.root[node] == v[first]
        off[:] = np.where(known, self.book["off2"][self.arrays["code.off2"][node]], 1.0)[of_v]
        q = np.flatnonzero(self.filter.may(2, v, w) & known[of_v])
        place = self._child("w", node, of_v[q], w[q])
        q, place = q[place >= 0], place[place >= 0]
        p[q] = self.book["p2"][self.arrays["code.p2"][place]]
        context = np.flatnonzero(np.append(True, new_v[1:] | (u[1:] != u[:-1])))
        some = context[self.filter.may(1, v[context], u[context]) & known[of_v[context]]]
        found = self._child("u", node, of_v[some], u[some])
        some, found = some[found >= 0], found[found >= 0]
        if len(some):
            nth = np.full(len(v), -1, np.int32)
            stop = np.append(context[1:], len(v))[np.searchsorted(context, some)]
            size = stop - some
            rows = np.repeat(some - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            nth[rows] = np.repeat(np.arange(len(some), dtype=np.int32), size)
            low = self.book["off3"][self.arrays["code.off3"][found]][nth[rows]]
            p[rows], off[rows] = p[rows] * low, off[rows] * low
            q = q[nth[q] >= 0]  # a trigram's bigram is in the model too
            q = q[self.filter.may(3, self.filter.mixed(v[q], u[q]), w[q])]
            place = self._child("uw", found, nth[q], w[q])
            q, place = q[place >= 0], place[place >= 0]
            p[q] += self.book["p3"][self.arrays["code.p3"][place]]
        return p, off

    def _child(self, level: str, node: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of words below node[at], -1 where they aren't."""
        word = self.codes.of(word)
        out = self.levels[level].child(node, np.maximum(word, 0), at)
        return np.where(word >= 0, out, -1)


class Filter:
    """Bits by a hash of (level, context, word), so that most n-grams that aren't in a part are told without a search."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, U(64 - (len(bits) * 8 - 1).bit_length())

    @staticmethod
    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * U(0x9E3779B97F4A7C15) + b * U(0xD6E8FEB86659FD93)
        return (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)

    def place(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.mixed(a + U(level), b) >> self.shift).astype(np.int64)

    def may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.place(level, a, b)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(grams: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Its bytes, eight bits an n-gram or more. grams: (level, contexts, words)."""
        n = sum(len(a) for _, a, _ in grams)
        bits = np.zeros(8 << max(6, (n - 1).bit_length() if n else 0), bool)
        own = Filter(np.zeros(len(bits) // 8, np.uint8))
        for level, a, b in grams:
            bits[own.place(level, a, b)] = True
        return np.packbits(bits, bitorder="little")


def kept_of(context: np.ndarray, c: np.ndarray, discount: float) -> tuple[np.ndarray, ...]:
    """Of n-grams with these context numbers: (which are kept, the number of each one's context among those that have any, discounted probabilities, what each such context leaves, which contexts these are)."""
    total = np.bincount(context, c, minlength=int(context.max(initial=-1)) + 1)
    keep = np.flatnonzero(c >= LEAST)
    p = (c[keep] - discount) / total[context[keep]]
    names, parent = np.unique(context[keep], return_inverse=True)
    return keep, parent, p, np.maximum(1e-9, 1 - np.bincount(parent, p, len(names))), names


def mapped(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file, each at a multiple of 8 bytes."""
    head, at = [], 1 << 13
    for k, x in arrays.items():
        head.append((k, x.dtype.str, at, x.nbytes))
        at += -(-x.nbytes // 8) * 8
    told = json.dumps(head).encode()
    whole = f"{path}.{uuid.uuid4().hex}"
    with open(whole, "wb") as f:
        f.write(len(told).to_bytes(8, "little") + told.ljust((1 << 13) - 8))
        for (_, _, at, _), x in zip(head, arrays.values(), strict=True):
            f.seek(at)
            f.write(np.ascontiguousarray(x).tobytes())
    os.replace(whole, path)  # another attempt's file is the same


class Model:
    """What every task knows: totals, the most frequent words, and where the parts are."""

    def __init__(self, raw: bytes):
        a = np.load(io.BytesIO(raw))
        self.total, self.distinct, self.parts, part_tokens = a["totals"].tolist()
        self.folder = str(a["folder"])
        self.words, self.count = Words(a["key"].view(U)), a["c"]
        self.p1 = (self.count + 1) / (self.total + self.distinct + 1)  # of the most frequent words
        self.log_p1 = np.log10(self.p1)
        self.split = np.ones(OTHER, np.int64)
        self.split[: len(self.count)] = -(-self.count // part_tokens)
        self.flush = min(MOST, max(FLUSH, 32 * self.parts))
        self.held: tuple[int, Part | None] = (-1, None)

    def named(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the most frequent words, hashes of others."""
        w = self.words.find(h)
        return np.where(w >= 0, w.astype(U), h)

    def splits(self, v: np.ndarray) -> np.ndarray:
        return self.split[np.where(v < TOP, v, START).astype(np.int64)]

    def place(self, v: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The part of the nth split of v."""
        return (tx.mix(tx.mix(v + U(0x5851F42D4C957F2D)) + nth.astype(U)) % U(self.parts)).astype(np.int64)

    def part_of(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part of each triple; what has no v is dealt out by w."""
        split = self.splits(v)
        new = np.append(True, (v[1:] != v[:-1]) | (split[1:] > 1) & (u[1:] != u[:-1]) | (v[1:] == START)) if len(v) else np.zeros(0, bool)
        first = np.flatnonzero(new)  # sorted rows have few different ones
        u, v, w, split, nth = u[first], v[first], w[first], split[first], np.zeros(len(first), np.int64)
        q = np.flatnonzero(split > 1)
        nth[q] = (tx.mix(u[q] + U(1)) % split[q].astype(U)).astype(np.int64)
        return np.repeat(self.place(np.where(v == START, w, v), nth), np.diff(np.append(first, len(new))))

    def path(self, part: int) -> str:
        return f"{self.folder}/{part >> 12}/{part}.trie"

    def find(self, part: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.held[0] != part:
            self.held = part, Part(self.path(part)) if os.path.exists(self.path(part)) else None
        return self.held[1].find(u, v, w) if self.held[1] else (np.zeros(len(w)), np.ones(len(w)))

    def score(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens that are all among the most frequent words, with all parts at hand."""
        grams, order = Grams.of(*before(self.named(h), at))
        u, v, w = grams.words()
        part, p, off, out = self.part_of(u, v, w), np.zeros(len(w)), np.ones(len(w)), np.zeros(len(w))
        for s in np.unique(part):
            q = np.flatnonzero(part == s)
            p[q], off[q] = self.find(int(s), u[q], v[q], w[q])
        out[order] = np.log10(p + off * self.p1[w.astype(np.int64)])
        return out


def before(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token with the two before it in its document."""
    first = np.zeros(len(w) + 1, bool)
    first[at[:-1]] = True
    v = np.where(first[:-1], START, np.append(START, w[:-1]))
    return np.where(first[:-1], START, np.append(START, v[:-1])), v, w


_models: dict[bytes, Model] = {}


def model_of(sent) -> Model:
    """This worker's model of a broadcast's bytes."""
    raw = sent.value
    key = hashlib.blake2b(raw, digest_size=16).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


class Trained(NamedTuple):
    """head: what every task is to know; counts: exact unigram counts (key, c); numbered: the documents as word numbers."""

    head: bytes
    counts: DataFrame
    numbered: DataFrame


def numbered(docs: DataFrame, sent, keep: tuple[str, ...]) -> DataFrame:
    """The `keep` columns of docs (with text) and row, n_tokens, n_known, base, words, others: the texts as word numbers, written once. n_known and base are of the most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = model_of(sent), TaskContext.get().partitionId() << 32
        for chunk in tx.chunks(batches):
            h, at = words_of(chunk)
            w = m.named(h)
            known = w < TOP
            base = np.zeros(len(w))
            base[known] = m.log_p1[w[known].astype(np.int64)]
            short, cut = np.where(known, w, ELSEWHERE).astype(np.uint32), np.concatenate([[0], np.cumsum(~known)])[at]
            others = w[~known]
            yield tx.batch(
                **{c: tx.column(chunk.rows, c) for c in keep}, row=row + np.arange(chunk.n), n_tokens=np.diff(at), n_known=tx.per_document(known, at), base=tx.per_document(base, at),
                words=pa.array([squeezed(short[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                others=pa.array([squeezed(others[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
            )
            row += chunk.n

    more = "row long, n_tokens long, n_known long, base double, words binary, others binary"
    return written(docs.select(*keep, "text").mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(more)])), "numbered")


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, w, row) of the tokens of batches (row, words, others)."""

    def done() -> tuple[np.ndarray, ...]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return *before(np.concatenate(held), at), np.repeat(np.array(names, U), np.diff(at))

    held, names, size = [], [], 0
    for rows in batches:
        for row, short, others in zip(*(rows[c].to_pylist() for c in ("row", "words", "others")), strict=True):
            x = loose(short, np.uint32).astype(U)
            if others:
                x[x == ELSEWHERE] = loose(others, U)
            held.append(x)
            names.append(row)
            size += len(x)
            if size >= FLUSH // 4:
                yield done()
                held, names, size = [], [], 0
    if held:
        yield done()


def routed(m: Model, grams: Grams, more: dict[str, np.ndarray], deal: bool) -> Iterator[pa.RecordBatch]:
    """Rows (part, salt, key, rest, more...) with arrays as bytes. With `deal`, a row has at most twice a part's mean, and what is over goes out under another salt."""
    part = m.part_of(*grams.words())
    order = np.argsort(part.astype(np.uint16) if m.parts <= 1 << 16 else part, kind="stable")  # within a part the order stays
    room = 2 * len(part) // m.parts + 1024 if deal else len(part)
    edge = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(part)).tolist()  # parts that have any
    pieces = [(part[order[a]], i, order[lo : min(lo + room, b)]) for a, b in zip(edge, edge[1:], strict=False) for i, lo in enumerate(range(a, b, room))]
    for i in range(0, len(pieces), 64):
        some = pieces[i : i + 64]
        told = [grams.take(q).bytes() for *_, q in some]
        cells = {"part": pa.array([int(x[0]) for x in some], pa.int32()), "salt": pa.array([x[1] for x in some], pa.int32()), "key": pa.array([x[0] for x in told], pa.binary()), "rest": pa.array([x[1] for x in told], pa.binary())}
        yield tx.batch(**cells, **{name: pa.array([f(q) for *_, q in some], pa.binary()) for name, f in more.items()})


ROUTED = "part int, salt int, key binary, rest binary"


def train(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), training: str | None = None, words: int = WORDS, discount: float = DISCOUNT, part_tokens: int = PART_TOKENS) -> Trained:
    """The model of docs (the `keep` columns, text), or of those where the boolean column `training` is true. words and part_tokens change no score."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = written((docs.where(training) if training else docs).select("text").mapInArrow(counting, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "unigrams")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    parts = -(-total // part_tokens) or 1
    folder = shared_dir(spark)
    if "://" in folder.removeprefix("file://"):
        raise ValueError("spark.checkpoint.dir must be a folder that tasks can open as files")
    folder = f"{folder.removeprefix('file://').removeprefix('file:')}/tallyvox/ngrams-{uuid.uuid4().hex}"
    most = counts.orderBy(F.col("c").desc(), "key").limit(words).toArrow()
    out = io.BytesIO()
    np.savez(out, totals=np.array([total, distinct, parts, part_tokens]), folder=np.array(folder), **{x: most[x].to_numpy().astype(np.int64) for x in ("key", "c")})
    sent = spark.sparkContext.broadcast(out.getvalue())
    table = numbered(docs, sent, tuple(dict.fromkeys([*keep, training] if training else keep)))
    if total:
        build(spark, (table.where(training) if training else table).select("row", "words", "others"), sent, folder, discount)
    return Trained(out.getvalue(), counts, table)


def build(spark: SparkSession, table: DataFrame, sent, folder: str, discount: float) -> None:
    """Write all parts."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for u, v, w, _ in gathered(texts(batches), model_of(sent).flush):
            q = v != START
            yield u[q], v[q], w[q]

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigrams of split words: a row for each of a number of ranges of their hash, so that none grows with the corpus."""
        m = model_of(sent)
        for _, v, w in tokens(batches):
            q = m.splits(v) > 1
            order, first = in_order(*(Codes(np.zeros(0, U)).of(x[q & (w < TOP)]) for x in (v, w)))
            pairs = [x[q & (w < TOP)][order][first] for x in (v, w)], np.diff(np.append(first, len(order)))
            rare = q & (w >= TOP)  # each on its own
            a, b, c = np.append(pairs[0][0], v[rare]), np.append(pairs[0][1], w[rare]), np.append(pairs[1], np.ones(int(rare.sum()), np.int64))
            yield from packs(m.place(tx.mix(a) ^ b, np.zeros(len(a), U)), a, b, c)

    def packs(part: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(part):
            return
        order = np.argsort(part, kind="stable")
        names, edge = np.unique(part[order], return_index=True)
        at = [order[a:b] for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True)]
        for i in range(0, len(at), 64):
            yield tx.batch(part=names[i : i + 64].astype(np.int32), **{k: pa.array([squeezed(f(q)) for q in at[i : i + 64]], pa.binary()) for k, f in (("v", lambda q: v[q].astype(np.uint32)), ("w", lambda q: w[q]), ("c", lambda q: c[q].astype(U)))})

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        now, held = None, []
        for rows in batches:
            for r in rows.to_pylist():
                if r["part"] != now and held:
                    yield now, held
                    held = []
                now = r["part"]
                held.append(r)
        if held:
            yield now, held

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of split words' bigrams, to each of their parts."""
        m = model_of(sent)
        for _, held in groups(batches):
            v, w, c = (np.concatenate([loose(r[k], kind).astype(U) for r in held]) for k, kind in (("v", np.uint32), ("w", U), ("c", U)))
            order = np.lexsort((w, v))
            first = np.flatnonzero(np.append(True, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])))
            v, w, c = v[order][first], w[order][first], np.add.reduceat(c[order], first)
            times = m.splits(v)
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            v, w, c = (np.repeat(x, times) for x in (v, w, c))
            yield from packs(m.place(v, nth), v, w, c)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(sent)
        for u, v, w in tokens(batches):
            found, _ = Grams.of(u, v, w)
            first = np.flatnonzero(np.append(True, found.key[1:] != found.key[:-1])) if len(found.key) else np.zeros(0, np.int64)
            c = np.append(np.diff(np.append(first, len(found.key))), np.ones(found.rest.shape[1], np.int64)).astype(np.uint32)
            yield from routed(m, Grams(found.key[first], found.rest), {"c": lambda q, c=c: squeezed(c[q])}, deal=False)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, built = model_of(sent), 0
        os.makedirs(folder, exist_ok=True)
        for part, held in groups(batches):
            own, split = [r for r in held if r["v"] is None], [r for r in held if r["v"] is not None]
            of = [Grams.read(r["key"], r["rest"]).words() for r in own]
            found = [np.concatenate([x[i] for x in of]) if of else np.zeros(0, U) for i in range(3)]
            c = np.concatenate([loose(r["c"], np.uint32) for r in own]).astype(np.int64) if own else np.zeros(0, np.int64)
            two = [np.concatenate([loose(r[k], kind) for r in split]).astype(U) if split else np.zeros(0, U) for k, kind in (("v", np.uint32), ("w", U), ("c", U))]
            os.makedirs(os.path.dirname(m.path(part)), exist_ok=True)
            Part.write(m.path(part), (*found, c), (*two[:2], two[2].astype(np.int64)), discount)
            built += 1
        yield tx.batch(built=np.array([built]))

    with cleaned(spark):
        some = table.mapInArrow(hot, "part int, v binary, w binary, c binary").repartition("part").sortWithinPartitions("part")
        split = written(some.mapInArrow(totals, "part int, v binary, w binary, c binary"), "split-words")
        own = table.mapInArrow(grams, f"{ROUTED}, c binary").drop("salt")
        both = own.unionByName(split, allowMissingColumns=True).repartition("part").sortWithinPartitions("part")
        both.mapInArrow(write, "built long").agg(F.sum("built")).collect()


class cleaned:
    """Shuffle files of the queries within go when each query ends; else they stay on disk beside those that follow."""

    def __init__(self, spark: SparkSession):
        self.conf, self.before = spark.conf, spark.conf.get(CLEANUP, "false")

    def __enter__(self) -> None:
        self.conf.set(CLEANUP, "true")

    def __exit__(self, *_) -> None:
        self.conf.set(CLEANUP, self.before)


def score(trained: Trained, docs: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and n_tokens, n_known, train_tokens, base_score, score and gain (the score less the base, a token) of docs (with text), by default of the documents given to train()."""
    spark = trained.counts.sparkSession
    sent = spark.sparkContext.broadcast(trained.head)
    total, distinct = np.load(io.BytesIO(trained.head))["totals"].tolist()[:2]
    table = trained.numbered if docs is None else numbered(docs, sent, keep)

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(sent)
        for u, v, w, row in gathered(texts(batches), model_of(sent).flush):
            found, at = Grams.of(u, v, w)
            new = np.append(True, row[1:] != row[:-1])  # rows rise
            names = row[new]
            told, nth = rising(names), (np.cumsum(new) - 1)[at].astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
            yield from routed(m, found, {"names": lambda q, told=told: told, "nth": lambda q, nth=nth: squeezed(nth[q])}, deal=True)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each text's tokens in a part (home, names, score), and tokens of less frequent words (key, row, p, off)."""
        m = model_of(sent)

        def done(part: int, held: list[tuple[Grams, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key, rest = np.concatenate([g.key for g, *_ in held]), np.concatenate([g.rest for g, *_ in held], axis=1)
            every = np.unique(np.concatenate([names for _, names, _ in held]))
            nth = [np.searchsorted(every, names)[n] for _, names, n in held]
            nth = np.concatenate([n[: len(g.key)] for n, (g, *_) in zip(nth, held, strict=True)]), np.concatenate([n[len(g.key) :] for n, (g, *_) in zip(nth, held, strict=True)])
            order, last = np.argsort(key), np.lexsort(rest[:2])
            u, v, w = Grams(key[order], rest[:, last]).words()
            nth = np.append(nth[0][order], nth[1][last])
            p, off = m.find(part, u, v, w)
            known = w < TOP
            value = np.log10(p[known] + off[known] * m.p1[w[known].astype(np.int64)])
            total = np.bincount(nth[known], value, len(every))
            has = np.flatnonzero(np.bincount(nth[known], minlength=len(every)))
            names, total, row = every[has], total[has].astype(np.float32), every[nth[~known]]
            edge = np.flatnonzero(np.diff(names >> U(32), prepend=U(1 << 62)))
            cut = zip(edge.tolist(), [*edge[1:].tolist(), len(names)], strict=False)  # a partition's texts each
            out = [(int(names[a] >> U(32)), rising(names[a:b]), squeezed(total[a:b]), None, None, None, None) for a, b in cut]
            if not known.all():
                out.append((-1, None, None, w[~known].view(np.int64), row.view(np.int64), p[~known], off[~known]))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return tx.batch(**{c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(zip(("home", "names", "score", "key", "row", "p", "off"), kinds, strict=True))})

        now, held, size = -1, [], 0
        for rows in batches:
            for r in rows.to_pylist():
                if held and (r["part"] != now or size >= FLUSH):
                    yield done(now, held)
                    held, size = [], 0
                names, now = risen(r["names"]), r["part"]
                held.append((Grams.read(r["key"], r["rest"]), names, loose(r["nth"], np.uint16 if len(names) <= 1 << 16 else np.uint32)))
                size += len(held[-1][2])
        if held:
            yield done(now, held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def done() -> pa.RecordBatch:
            names, back = np.unique(np.concatenate(held[0]), return_inverse=True)
            return tx.batch(row=tx.ints(names), score=np.bincount(back, np.concatenate(held[1]), len(names)))

        for rows in batches:
            for r in rows.to_pylist():
                if r["home"] != now and held[0]:
                    yield done()
                    held = ([], [])
                now = r["home"]
                held[0].append(risen(r["names"]))
                held[1].append(loose(r["score"], np.float32).astype(float))
        if held[0]:
            yield done()

    with cleaned(spark):
        sent_out = table.select("row", "words", "others").mapInArrow(lookups, f"{ROUTED}, names binary, nth binary").repartition("part", "salt").sortWithinPartitions("part")
        found = written(sent_out.mapInArrow(answers, "home int, names binary, score binary, key array<long>, row array<long>, p array<double>, off array<double>"), "answers")
        frequent = found.where("home >= 0").select("home", "names", "score").repartition("home").sortWithinPartitions("home").mapInArrow(sums, "row long, score double")
        p1 = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1))
        rare = found.where("home < 0").select(F.explode(F.arrays_zip("key", "row", "p", "off")).alias("x")).select("x.*").join(trained.counts, "key", "left")
        rare = rare.select("row", F.col("c").isNotNull().cast("long").alias("more"), F.log10(p1).alias("base"), F.log10(F.col("p") + F.col("off") * p1).alias("score"))
        none = F.lit(0)
        each = frequent.select("row", none.cast("long").alias("more"), none.cast("double").alias("more_base"), "score").unionByName(rare.withColumnRenamed("base", "more_base"))
        each = written(each.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more", "more_base", "score"))), "sums")
    joined = table.select(*keep, "row", "n_tokens", "n_known", "base").join(each, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0))
    return joined.select(*keep, "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).alias("train_tokens"), base.alias("base_score"), "score", ((F.col("score") - base) / F.col("n_tokens")).alias("gain"))


def held_out(doc_id: Column, of: int = 7, which: int = 2) -> Column:
    """Whether crc32 of the id as text leaves `which`; a null id is training text."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of == which, F.lit(False))
