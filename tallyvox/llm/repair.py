"""Re-Pair grammar compression of token ids.

Documents are ordered by id over range partitions; a partition is a shard, cut into blocks of a bounded number of tokens.
In each block the most frequent pairs of neighbouring symbols become nonterminals, many at a time, until no pair is found
`least` times. A block's record holds its rules, their expansion lengths, the remaining sequence and where each document
begins, so that any document can be decoded from the symbols that cover it.

Null text is an empty document (its end id alone); documents with a null id come first; rows that share an id are ordered
by a hash of their text; an empty table gives no blocks. A very long text is one block, with those before it that fill none. Columns other than the two named are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .packing import bases
from .scratch import written
from .tokens import Encoder

MAGIC = b"RPG2"
#: Ids a block has, about: its tables stay in a core's cache. Larger blocks are smaller by some 8 % for each doubling, and slower.
BLOCK = 1 << 18
#: A rule takes about five bytes, a replaced pair saves two: rules for rarer pairs make blocks longer again.
LEAST = 8
_SLOT_BITS = 17


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - _SLOT_BITS)).astype(np.intp)


class Tables:
    """Room for a number and a pair in each slot; whoever fills it empties it again."""

    def __init__(self):
        self.number, self.pair = np.full(1 << _SLOT_BITS, -1, np.int32), np.zeros(1 << _SLOT_BITS, np.uint64)


def replaced(seq: np.ndarray, at: np.ndarray, slot: np.ndarray, bar: int, first: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules) after one round: of the pairs at the places `at` those found `bar` times or more become symbols from `first` on. Where two overlap, the more frequent one counts; what is left over, and pairs whose slot another one holds, wait for the next round."""
    key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    tables.pair[slot] = key
    held = np.flatnonzero(tables.pair[slot] == key)
    count = np.bincount(slot[held], minlength=1 << _SLOT_BITS).astype(np.int32) if len(held) > 1 << 14 else None
    if count is None:  # few places: the slots met instead of all
        own, back, n = np.unique(slot[held], return_inverse=True, return_counts=True)
        n_at = n[back].astype(np.int32)
    else:
        n_at = count[slot[held]]
    some = n_at >= bar
    held, n_at = held[some], n_at[some]
    at, slot, key = at[held], slot[held], key[held]
    near = np.flatnonzero(at[1:] - at[:-1] == 1)
    keep = np.ones(len(at), bool)
    left, right = near, near + 1
    more, less = n_at[left] > n_at[right], n_at[left] < n_at[right]
    even = ~(more | less)
    alike = even & (slot[left] == slot[right])
    by_slot = even & ~alike
    more |= by_slot & (slot[left] > slot[right])
    keep[right[more]] = False
    keep[left[~more & ~alike]] = False
    if alike.any():  # overlapping pairs alike: every other one
        run = np.ones(len(at), bool)
        run[right[alike]] = False
        begin = np.flatnonzero(run)
        keep &= (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
    at, slot, key = at[keep], slot[keep], key[keep]
    if len(at) > 1 << 14:
        count = np.bincount(slot, minlength=1 << _SLOT_BITS)
        good = np.flatnonzero(count >= max(2, bar // 2))
    else:
        own, n = np.unique(slot, return_counts=True)
        good = own[n >= max(2, bar // 2)]
    tables.number[good] = np.arange(len(good), dtype=np.int32)
    rule = tables.number[slot]
    tables.number[good] = -1
    pair = tables.pair[good]
    some = rule >= 0
    at, rule = at[some], rule[some]
    seq[at] = rule.astype(np.uint32) + np.uint32(first)
    stays = np.ones(len(seq), bool)
    stays[at + 1] = False
    return seq[stays], np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def compress(ids: np.ndarray, vocabulary: int, *, least: int = LEAST, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rules[k] is the pair that symbol vocabulary + k stands for. The count that a pair needs falls by `step` to `least`; then rounds go on until no pair of unlike symbols has it."""
    seq, rules, first, bar, tables = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], vocabulary, None, Tables()
    while len(seq) > 1:
        slot = _slots(seq[:-1], seq[1:])
        count = np.bincount(slot, minlength=1 << _SLOT_BITS)
        top = int(count.max())
        if top < least:
            break
        last = bar == least
        bar = max(least, min(top // 2, bar or top) // step)
        at = np.flatnonzero((count >= bar)[slot])
        slot, found = slot[at], False
        while len(at):
            seq, new = replaced(seq, at, slot, bar, first, tables)
            if not len(new):
                break
            found = True
            rules.append(new)
            fresh = seq >= first  # a pair can only have become more frequent with a new symbol
            first += len(new)
            if bar > least:  # what is left over is found at the next bar
                break
            at = np.flatnonzero(fresh[:-1] | fresh[1:])
            slot = _slots(seq[at], seq[at + 1])
        if last and not found:
            break
    # a frequent pair may share its slot with a rare one: what is left is counted by sorted keys
    while len(seq) > 1:
        at, rank = _frequent(seq, least)
        if not len(at):
            break
        seq, new = replaced(seq, at, rank, least, first, tables)
        if not len(new):  # all of them overlap with others: the most frequent one alone
            unlike = seq[at] != seq[at + 1]
            if not unlike.any():
                break
            one = rank == np.bincount(rank[unlike]).argmax()
            seq, new = replaced(seq, at[one], rank[one], least, first, tables)
        rules.append(new)
        first += len(new)
    return seq, np.concatenate(rules)


def _frequent(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs found `least` times or more, each with a number of its pair."""
    slot = _slots(seq[:-1], seq[1:])
    at = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= least)[slot])
    _, back, n = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], return_inverse=True, return_counts=True)
    often = n >= least
    number = np.cumsum(often) - 1
    some = (often & (number < 1 << _SLOT_BITS))[back]
    return at[some], number[back[some]]


def batches_of(rules: np.ndarray, vocabulary: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that refer to earlier ones only."""
    most, i = rules.astype(np.int64).max(axis=1, initial=0) - vocabulary, 0
    while i < len(rules):
        later = most[i:] >= i
        j = i + int(later.argmax()) if later.any() else len(rules)
        yield i, j
        i = j


def lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each nonterminal expands to."""
    out, a = np.zeros(len(rules), np.int64), rules.astype(np.int64) - vocabulary
    for i, j in batches_of(rules, vocabulary):
        out[i:j] = np.where(a[i:j] < 0, 1, out[np.maximum(a[i:j], 0)]).sum(axis=1)
    return out


def narrow(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by their low 16 bits and, a bit at a time, the others that any has."""
    bits = max(16, int(x.max(initial=0)).bit_length())
    return b"".join([struct.pack("<IB", len(x), bits), x.astype("<u2").tobytes(), *(np.packbits((x >> j & 1).astype(np.uint8)).tobytes() for j in range(16, bits))])


def widened(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """(numbers, the place after them)."""
    n, bits = struct.unpack_from("<IB", raw, at)
    out, at = np.frombuffer(raw, "<u2", n, at + 5).astype(np.int64), at + 5 + 2 * n
    for j in range(16, bits):
        out |= np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(np.int64) << j
        at += -(-n // 8)
    return out, at


class Block:
    """A block as it is stored."""

    def __init__(self, vocabulary: int, rules: np.ndarray, expands: np.ndarray, sequence: np.ndarray, at: np.ndarray):
        self.vocabulary, self.rules, self.expands, self.sequence, self.at = vocabulary, rules, expands, sequence, at
        self._table = self._ends = None

    @staticmethod
    def of(ids: np.ndarray, at: np.ndarray, vocabulary: int) -> Block:
        sequence, rules = compress(ids, vocabulary)
        return Block(vocabulary, rules, lengths(rules, vocabulary), sequence, at)

    def to_bytes(self) -> bytes:
        return b"".join([MAGIC, struct.pack("<I", self.vocabulary), *(narrow(x) for x in (self.rules.ravel(), self.expands, self.sequence, np.diff(self.at)))])

    @staticmethod
    def from_bytes(raw: bytes) -> Block:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of this format")
        found, i = [], 8
        for _ in range(4):
            x, i = widened(raw, i)
            found.append(x)
        return Block(struct.unpack_from("<I", raw, 4)[0], found[0].reshape(-1, 2), found[1], found[2], np.concatenate([[0], np.cumsum(found[3])]))

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all nonterminals one after the other, behind those of the vocabulary, and where each begins."""
        v, begin = self.vocabulary, self.vocabulary + np.cumsum(self.expands) - self.expands
        out = np.concatenate([np.arange(v, dtype=np.uint32), np.zeros(int(self.expands.sum()), np.uint32)])
        at, size = np.concatenate([np.arange(v), begin]), np.concatenate([np.ones(v, np.int64), self.expands])
        for i, j in batches_of(self.rules, v):
            both = self.rules[i:j].ravel()
            stop = np.cumsum(size[both])
            out[begin[i] : begin[i] + stop[-1]] = out[np.repeat(at[both] - (stop - size[both]), size[both]) + np.arange(stop[-1])]
        return out, at

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of documents first to last-1 (all by default), from the symbols that cover them. A block's rules are expanded once, when it is first asked."""
        last = len(self.at) - 1 if last is None else last
        if self._ends is None:
            size = np.ones(len(self.sequence), np.int64)
            big = self.sequence >= self.vocabulary
            size[big] = self.expands[self.sequence[big] - self.vocabulary]
            self._ends = np.cumsum(size)
            self._table = self._expanded()
        ends = self._ends
        lo, hi = np.searchsorted(ends, self.at[first], "right"), np.searchsorted(ends, self.at[last], "left") + 1
        symbols, size = self.sequence[lo:hi], np.diff(ends[lo:hi], prepend=ends[lo - 1] if lo else 0)
        source, at = self._table
        stop = np.cumsum(size)
        out = source[np.repeat((at[symbols] - (stop - size)).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)]
        skip = int(self.at[first] - (ends[lo - 1] if lo else 0))
        return out[skip : skip + int(self.at[last] - self.at[first])]


SCHEMA = "part int, block int, first long, n_tokens long, doc_ids array<long>, payload binary"


def encode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Blocks in ascending id order: (part, block) orders them, first counts the ids before a block in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        vocabulary = len(encoder.bytes_per_id)
        held, sizes, names, nth, first = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, at = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return tx.batch(part=np.array([part], np.int32), block=np.array([nth], np.int32), first=np.array([first]), n_tokens=np.array([len(ids)]), doc_ids=pa.array([sum(names, [])], pa.list_(pa.int64())), payload=pa.array([Block.of(ids, at, vocabulary).to_bytes()], pa.binary()))

        for chunk in tx.chunks(batches, "text", keeps="tokens"):
            ids, at = encoder.encode(tx.column(chunk.rows, "text").to_pylist(), end_id)
            held.append(ids)
            sizes.append(np.diff(at))
            names.append(tx.column(chunk.rows, "doc_id").to_pylist())
            n = sum(map(len, held))
            if n >= block:
                yield flush()
                held, sizes, names, nth, first = [], [], [], nth + 1, first + n
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """The table of blocks, written (to path, or to the shared folder) and ready to be read again."""
    blocks = encode(docs, tokenizer, **options)
    if path is None:
        return written(blocks, "repair")
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it, ids are unsigned 32-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, first, raw in zip(rows["doc_ids"], rows["first"].to_pylist(), rows["payload"], strict=True):
                found = Block.from_bytes(raw.as_py())
                step = max(1, len(found.at) // max(1, int(found.at[-1]) >> 18))
                for i in range(0, len(found.at) - 1, step):
                    j = min(i + step, len(found.at) - 1)
                    at = found.at[i : j + 1]
                    yield tx.batch(doc_id=name.values.slice(i, j - i), start=first + at[:-1], n_tokens=np.diff(at), ids=tx.slices(found.decode(i, j).astype("<u4"), at - at[0]))

    placed = blocks.join(F.broadcast(bases(blocks)), "part").select("doc_ids", (F.col("base") + F.col("first")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
