"""Concatenate and cut: documents' ids one after the other, cut into windows of a fixed length.

Pass 1 tokenizes each partition once, writes the ids to a table, and numbers tokens within the partition. Partition totals
then give each partition's global offset (prefix sums over one row a partition). Pass 2 cuts each document at the
multiples of the window length; a piece is its boundary record. Only the last window can be short; it's padded to the full
length, unless its own is a power of two.

Null text is an empty document (its end id alone); a null id stays null; repeated rows are packed again; of an empty table
nothing comes out. Very long texts are tokenized and packed whole; one text is in memory at a time, some 40 bytes a byte of it.
Columns other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written
from .tokens import Encoder


def tokenized(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids): ids as little-endian integers of the width that the vocabulary needs, end_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for chunk in tx.chunks(batches, "text", keeps="tokens"):
            ids, at = encoder.encode(tx.column(chunk.rows, "text").to_pylist(), end_id)
            yield tx.batch(part=np.full(chunk.n, part, np.int32), doc_id=tx.column(chunk.rows, "doc_id"), local_start=start + at[:-1], n_tokens=np.diff(at), ids=tx.slices(ids, at))
            start += len(ids)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids binary")


def bases(parts: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(part, base, whole): tokens before each partition and in all. One row a partition goes through one task: as many as Spark's own scheduler holds."""
    totals = parts.groupBy("part").agg(F.sum(size).alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy()).alias("whole"))


def pack(docs: DataFrame, tokenizer: str, *, length: int = 1024, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start (the document's ids before it), length, doc_tokens, sequence_id, offset, padded_length (of the piece's sequence), ids (binary, unsigned 32-bit little-endian)."""
    table = written(tokenized(docs, tokenizer, doc_id=doc_id, text=text, end_id=end_id), "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, "ids", keeps="tokens"):
            rows = chunk.rows
            first, size, whole = (tx.column(rows, c).to_numpy().astype(np.int64) for c in ("first", "n_tokens", "whole"))
            if not len(size):
                continue
            wide = np.dtype(f"<u{len(chunk.buf) // max(1, int(size.sum())) or 2}")
            ids = np.frombuffer(chunk.buf.tobytes(), wide).astype("<u4")
            pieces = (first + size - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(size)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + nth
            begin = np.maximum(sequence * length, first[row])
            stop = np.minimum((sequence + 1) * length, first[row] + size[row])
            at = np.append(np.cumsum(stop - begin) - (stop - begin), len(ids))
            yield tx.batch(doc_id=tx.column(rows, "doc_id").take(pa.array(row)), start=begin - first[row], length=stop - begin, doc_tokens=size[row], sequence_id=sequence, offset=begin - sequence * length, padded_length=padded_length(np.minimum(length, whole[row] - sequence * length), length), ids=tx.slices(ids, at))

    placed = table.join(F.broadcast(bases(table)), "part").select("doc_id", "n_tokens", (F.col("base") + F.col("local_start")).alias("first"), "whole", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary")


def padded_length(n: np.ndarray, length: int = 1024) -> np.ndarray:
    """What sequences of n ids are padded to: the full length, except where n is a power of two."""
    return np.where(n & (n - 1) == 0, n, length)
