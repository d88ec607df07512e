"""Runs of repeated words: maximal stretches that a short sequence of words fills at least four times over.

Karp, Miller and Rosenberg's names: the words of a chunk of documents are numbered by comparison, then stretches of 2, 4, 8 ...
words get equal numbers where their halves have equal ones. How far two places agree is told by going down the levels, forward
and backward. A run of period p and at least 4p words covers a multiple of 3p together with the word p further on, so only these
grid places are tried, (n/3) ln n for n words; where the two words are the same, the names extend them. Nothing is hashed, and no
suffixes are sorted. Of the periods that fill the same stretch the smallest stays, which is its smallest period, since at four
times its length every other one is a multiple of it.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]. Null, empty and blank texts have no words and no runs. Each row is
looked at alone: repeated rows have the same result, an empty table gives no rows. Very long texts are searched whole: a word
takes some 100 bytes and 4 more for each level of names, of which there are as many as the longest stretch found twice has binary
digits; grid places are tried in blocks. Other columns aren't read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: A run repeats its period so many times, and has so many words, at least.
TIMES, LEAST = 4, 6
#: Grid places tried at once.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def named(key: np.ndarray) -> np.ndarray:
    """Numbers from 1 for keys that occur again, 0 for the others."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    again = size > 1
    out = np.empty(len(key), np.int32)
    out[order] = np.repeat(np.where(again, np.cumsum(again), 0), size)
    return out


def levels(words: np.ndarray) -> list[np.ndarray]:
    """The names of stretches of 1, 2, 4 ... words at each place, up to those found twice; a stretch found once has 0, as has the place behind the end."""
    out, now, k = [], named(words), 0
    while now.any():
        out.append(np.append(now, np.int32(0)))
        at = np.flatnonzero(now[: -(1 << k)])
        at = at[now[at + (1 << k)] > 0]
        pair = named(now[at].astype(np.int64) << 32 | now[at + (1 << k)])
        now = np.zeros(len(words), np.int32)
        now[at] = pair
        k += 1
    return out


def agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i on are those from j on, and how many before i are those before j; i < j."""
    fore, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, n = names[k], len(names[k]) - 1
        a = name[np.minimum(i + fore, n)]
        fore += ((a == name[np.minimum(j + fore, n)]) & (a > 0)) * (1 << k)
        to = i - back - (1 << k)
        a = name[np.where(to < 0, n, to)]
        back += ((a == name[np.maximum(j - back - (1 << k), 0)]) & (a > 0)) * (1 << k)
    return fore, back


def grid(at: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid places of all periods, in blocks. at: the documents' first words, and the end."""
    size = np.diff(at)
    most = size // times
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (times - 1) * period
    n = (size[doc] - period + step - 1) // step
    done = np.concatenate([[0], np.cumsum(n)])
    for first in range(0, int(done[-1]), BLOCK):
        j = np.arange(first, min(first + BLOCK, int(done[-1])))
        of = np.searchsorted(done, j, "right") - 1
        yield at[doc[of]] + (j - done[of]) * step[of], period[of]


def runs(words: np.ndarray, at: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in all documents, by start and period. words: their numbers; no run crosses documents."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    names = levels(doc * (int(words.max(initial=0)) + 1) + words) if len(words) else []
    found = [np.zeros((3, 0), np.int64)]
    for i, p in grid(at, times) if names else ():
        a = names[0][i]
        same = np.flatnonzero((a == names[0][i + p]) & (a > 0))
        i, p = i[same], p[same]
        fore, back = agree(names, i, i + p)
        long = fore + back + p >= np.maximum(least, times * p)
        found.append(np.stack([(i - back)[long], (fore + back + p)[long], p[long]]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def spelled(chunk: tx.Chunk, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow column."""
    if not len(starts):
        return pa.array([], pa.string())
    offsets = np.stack([starts, ends], 1).ravel().astype(np.int32)  # a word and the gap behind it in turn
    both = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chunk.buf)))
    return both.take(pa.array(np.arange(0, len(offsets), 2)))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: Callable[[int | None, int], np.ndarray | None] | None = None, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed: the words that no run holds behind its first period, joined by one space.

    order(doc_id, number of words): the words that take the place of a document's words, by their numbers, or None for the words
    as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            starts, ends, at = chunk.words()
            words = spelled(chunk, starts, ends)
            number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            place = np.arange(len(number))
            for d, name in enumerate(tx.column(chunk.rows, "doc_id").to_pylist() if order else ()):
                if at[d + 1] > at[d] and (moved := order(name, int(at[d + 1] - at[d]))) is not None:
                    place[at[d] : at[d + 1]] = at[d] + moved
            start, length, period = runs(number[place], at, times, least)
            edge = np.zeros(len(number) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            stays = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(stays)])[at].astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.take(pa.array(place[stays]))), " ")
            of = np.searchsorted(start, at).astype(np.int32)
            doc = np.searchsorted(at, start, "right") - 1
            listed = pa.StructArray.from_arrays([tx.ints(start - at[doc]), tx.ints(length), tx.ints(period)], names=["start", "length", "period"])
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), n_words=np.diff(at), runs=pa.ListArray.from_arrays(pa.array(of), listed), collapsed=joined)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
