"""Words, shingles and hashes of Arrow text columns, as numpy arrays over whole chunks of documents.

A chunk is the bytes of several texts one after the other; a document longer than the chunk size is a chunk of its own.
Hashes are 64-bit: eight bytes at a time go into the state, which is mixed after each; spans of over LONG bytes have BLAKE2b's.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
try:  # glibc: large arrays go back to the system when they are freed, instead of staying with the worker
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)
except OSError:
    pass
WHITE = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
NOT_WHITE = ~WHITE
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words of letters and digits: lower-cased a-z, 0-9 and whatever isn't ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

U = np.uint64
_SEED, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: The low bytes of an eight that a span has left, by their number.
_LEFT = np.array([(1 << 8 * j) - 1 for j in range(9)], U)
#: Spans of more bytes are hashed one by one.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def eights(buf: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number, zeros beyond the end."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.array([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], U)


class Chunk:
    """rows: the record batch of these documents; buf: their bytes; at: where each begins, and the end."""

    def __init__(self, rows: pa.RecordBatch, buf: np.ndarray, at: np.ndarray):
        self.rows, self.buf, self.at = rows, buf, at
        self.n = len(at) - 1

    def lower(self) -> Chunk:
        return Chunk(self.rows, LOWER[self.buf], self.at)

    def words(self, of: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of bytes in `of` that stays in one document; the first word of each document, and the end."""
        m = of[self.buf]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        full = self.at[1:] > self.at[:-1]
        begin, end = self.at[:-1][full], self.at[1:][full] - 1
        first[begin], last[end] = m[begin], m[end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, the same wherever they stand."""
        size = ends - starts
        eight = eights(self.buf)
        out = mix((eight[starts] & _LEFT[np.minimum(size, 8)]) * _STEP + size.astype(U) * _SEED)
        todo, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(todo):
            left = size[todo] - k
            out[todo] = mix(out[todo] ^ (eight[starts[todo] + k] & _LEFT[np.minimum(left, 8)]) * _STEP)
            todo, k = todo[left > 8], k + 8
        long = np.flatnonzero(size > LONG)
        if len(long):
            out[long] = digests(self.buf.tobytes(), starts[long], ends[long])
        return out


def windows(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k consecutive items within a document, and the index of its first item. at: the documents' first items, and the end."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : j + n]
    ok = np.ones(n, bool)
    for back in range(1, k):  # windows that begin fewer than k items before a document's end
        stop = at[1:] - back
        stop = stop[(stop >= at[:-1]) & (stop < n)]
        ok[stop] = False
    idx = np.flatnonzero(ok)
    return mix(out[idx] + U(k)), idx


def whole(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of 1 to k-1 items: the document, and a hash of all its items."""
    size = at[1:] - at[:-1]
    short = np.flatnonzero((size > 0) & (size < k))
    out = np.zeros(len(short), U)
    for j in range(k - 1):
        has = size[short] > j
        out[has] = out[has] * _STEP + h[at[short[has]] + j]
    return short, mix(out + size[short].astype(U))


def trigrams(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (of a power of two) of each three bytes in a row that stay in one document, and the documents' offsets."""
    buf, at = chunk.buf.astype(np.uint32), chunk.at
    three = (buf[:-2] << np.uint32(16) | buf[1:-1] << np.uint32(8) | buf[2:]) if len(buf) > 2 else buf[:0]
    three = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))
    ok = np.ones(len(three), bool)
    for back in (1, 2):  # those that begin in a document's last two bytes run into the next one
        stop = at[1:] - back
        ok[stop[(stop >= at[:-1]) & (stop < len(three))]] = False
    return three[ok].astype(np.int32), np.concatenate([[0], np.cumsum(ok)])[np.minimum(at, len(three))]


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    out = rows.column(name)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, null as empty, and the rows' offsets from 0."""
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


#: What operators keep in a worker from task to task; it goes when a task of another operator comes.
KEPT: dict[str, dict] = {}


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK, keeps: str = "") -> Iterator[Chunk]:
    """keeps: the entry of KEPT that these tasks need."""
    for name, held in KEPT.items():
        if name != keeps:
            held.clear()
    for rows in batches:
        buf, at = bytes_of(column(rows, text))
        i = 0
        while i < rows.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield Chunk(rows.slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


def per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of each document's values."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False) if values.dtype != U else values.view(np.int64))


def slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of data's slices between consecutive offsets."""
    raw = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * raw.itemsize).astype(np.int64)), pa.py_buffer(raw.view(np.uint8))]).cast(pa.binary())


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
