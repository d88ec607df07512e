"""Lines that many documents have, told by levelled sorted runs of line hashes.

The store has levels of runs; a run is a set of rows (key, n), the documents of its batches that have the line, in buckets by key,
sorted within. A batch of documents is counted in its tasks and added so: a merge join takes out the keys that a run
already holds often enough (settled: more of them changes nothing), and the rest become a run of level 0. When a level has FANOUT
runs they are merged into one of the next, so a key is rewritten once a level, and few runs are read for a batch. All runs have the
same buckets, so that neither joins nor merges shuffle them: only a batch's own counts move.

A line's key is the line without the bytes [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; lines end at \\n alone. Keys are
told by 64-bit hashes. Null and empty texts have one empty line; keys of fewer than `min_chars` code points are never dropped.
Each row counts as a document, also when its id or text is repeated. Very long texts are cut into lines whole, and a line of any
length is one key. Of an empty table nothing comes out. Other columns aren't read, so names can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .decontam import FILTER_WORDS, filter_of
from .docs import KEY, keyed
from .scratch import shared_dir, small_batches, written

#: Documents that must have a line, and code points of its key, at least.
DOCUMENTS, CHARS = 10, 1
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Batches into which a table at rest is dealt.
BATCHES = 8


class Lines:
    """The lines of a chunk: begin and end, the first of each document and the end, and the keys' hashes (ok: of min_chars or more)."""

    def __init__(self, chunk: tx.Chunk, min_chars: int = CHARS):
        cut = np.flatnonzero(chunk.buf == 10)
        self.chunk = chunk
        self.starts, self.ends = np.sort(np.concatenate([chunk.at[:-1], cut + 1])), np.sort(np.concatenate([cut, chunk.at[1:]]))
        self.at = np.searchsorted(cut, chunk.at) + np.arange(chunk.n + 1)
        first, last, _ = chunk.words()
        lo, hi = np.searchsorted(first, self.starts), np.searchsorted(first, self.ends)
        full = hi > lo
        a, b = np.append(first, 0)[np.where(full, lo, -1)], np.append(last, 0)[np.where(full, hi - 1, -1)]
        chars = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
        self.ok = full & (chars[b] - chars[a] >= min_chars)
        self.keys = np.zeros(len(self.starts), np.uint64)
        self.keys[self.ok] = chunk.lower().hashes(a[self.ok], b[self.ok])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), np.diff(self.at))

    def without(self, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts without these lines, and their offsets. A line goes with the \\n behind it; where the last one of a document goes, so does the \\n behind the last that stays."""
        last = self.at[1:] - 1
        behind = self.ends + 1
        behind[last] -= 1  # a document's last line has no \\n
        edge = np.zeros(len(self.chunk.buf) + 1, np.int64)
        np.add.at(edge, self.starts[drop], 1)
        np.add.at(edge, behind[drop], -1)
        keep = np.cumsum(edge)[:-1] == 0
        stays = np.flatnonzero(~drop)
        end = stays[np.maximum(np.searchsorted(stays, self.at[1:]) - 1, 0)] if len(stays) else last  # of each document the last line that stays
        end = end[(end >= self.at[:-1]) & (end < last)]
        keep[self.ends[end]] = False
        return self.chunk.buf[keep], np.concatenate([[0], np.cumsum(keep)])[self.chunk.at]


def line_counts(docs: DataFrame, *, batch: str | None = None, text: str = "text", min_chars: int = CHARS) -> DataFrame:
    """(batch, key, n): documents that have each line key; batch: an int column that tells batches apart, 0 for all without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            lines = Lines(chunk, min_chars)
            doc, key = lines.doc()[lines.ok], lines.keys[lines.ok]
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            of = tx.column(chunk.rows, "batch").to_numpy(zero_copy_only=False)[doc]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, of = key[once], of[once]
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(new)
            yield tx.batch(batch=of[begin].astype(np.int32), key=tx.ints(key[begin]), n=np.diff(np.append(begin, len(key))))

    rows = docs.select(F.col(text).alias("text"), (F.col(batch).cast("int") if batch else F.lit(0)).alias("batch"))
    return rows.mapInArrow(run, "batch int, key long, n long").groupBy("batch", "key").agg(F.sum("n").alias("n"))


class Runs:
    """The store: a bucketed table for each level, below a folder that driver and executors share; each run is a set of its files. threshold: documents that settle a key.

    Tables are known to the session's catalog. Bucket files of several runs are read together by one task each, so a level is
    summed up where its buckets lie.
    """

    def __init__(self, spark: SparkSession, threshold: int = DOCUMENTS, *, folder: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        small_batches(spark)
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.name = f"tallyvox_lines_{uuid.uuid4().hex}"
        self.folder = folder or f"{shared_dir(spark)}/tallyvox/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[int] = []  # of each level

    def level(self, k: int) -> str:
        return f"{self.name}_{k}"

    def write(self, counts: DataFrame, k: int) -> None:
        """counts as a run of level k."""
        counts.select("key", "n").write.mode("append").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{self.level(k)}").saveAsTable(self.level(k))
        self.runs += [0] * (k + 1 - len(self.runs))
        self.runs[k] += 1

    def summed(self, k: int) -> DataFrame:
        """(key, n) of level k, a key once. No shuffle: a bucket has all rows of its keys."""
        return self.spark.table(self.level(k)).groupBy("key").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch's counts (key, n; a key once). Keys that a run holds as settled are left out."""
        new = counts.repartition(self.buckets, "key")
        for k in (k for k, n in enumerate(self.runs) if n):
            new = new.join(self.spark.table(self.level(k)).where(F.col("n") >= self.threshold).hint("merge"), "key", "left_anti")
        self.write(new, 0)
        k = 0
        while k < len(self.runs) and self.runs[k] >= self.fanout:
            self.compact(k)
            k += 1

    def compact(self, k: int) -> None:
        """The runs of level k as one of the next. It's written before they are removed."""
        self.write(self.summed(k), k + 1)
        self.drop(k)

    def drop(self, k: int) -> None:
        """Remove a level and its files."""
        self.runs[k] = 0
        self.spark.sql(f"DROP TABLE IF EXISTS {self.level(k)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.level(k)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settled(self) -> DataFrame:
        """(key): those that so many documents have. Moves all runs to the last level."""
        if not self.runs:
            return self.spark.createDataFrame([], "key long")
        for k in range(len(self.runs) - 1):
            if self.runs[k]:
                self.compact(k)
        return self.summed(len(self.runs) - 1).where(F.col("n") >= self.threshold).select("key")


def stripped(docs: DataFrame, settled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = CHARS, most: int = FILTER_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and text, without the lines whose key is in settled(key). Up to `most` keys are sent to all tasks; with more, each document's lines are joined with them."""
    kept = written(settled.select(F.col("key").alias("word")), "settled")
    members = filter_of(kept, most)
    sent = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            lines = Lines(chunk, min_chars)
            drop = np.zeros(len(lines.keys), bool)
            if sent.value is not None:
                drop[sent.value.find(lines.keys)[0]] = True
            else:
                found, of = tx.column(chunk.rows, "found"), lines.doc()
                for d in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                    drop[of == d] = np.isin(lines.keys[of == d], found[int(d)].values.to_numpy().view(np.uint64))
            drop &= lines.ok
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), n_lines=np.diff(lines.at), n_dropped=tx.per_document(drop.astype(np.int64), lines.at), text=tx.slices(*lines.without(drop)).cast(pa.string()))

    schema = "doc_id long, n_lines long, n_dropped long, text string"
    if members is not None:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    rows = keyed(docs, doc_id, text)
    found = line_keys(rows, min_chars).join(kept.withColumnRenamed("word", "key"), "key").groupBy(*KEY).agg(F.collect_set("key").alias("found"))  # of one document's lines
    return rows.join(found, KEY, "left").select("doc_id", "text", "found").mapInArrow(run, schema)


def line_keys(rows: DataFrame, min_chars: int = CHARS) -> DataFrame:
    """(doc, same, key) of the lines of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            lines = Lines(chunk, min_chars)
            d = pa.array(lines.doc()[lines.ok])
            yield tx.batch(doc=tx.column(chunk.rows, "doc").take(d), same=tx.column(chunk.rows, "same").take(d), key=tx.ints(lines.keys[lines.ok]))

    return rows.select(*KEY, "text").mapInArrow(run, "doc long, same long, key long")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, min_chars: int = CHARS, batches: int = BATCHES, most: int = FILTER_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines (before), n_dropped and text, without the lines that `documents` rows or more have. The table is counted in one pass and added in batches by id."""
    spark = docs.sparkSession
    dealt = docs.select(F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(batches)).cast("int").alias("batch"))
    counts = written(line_counts(dealt, batch="batch", min_chars=min_chars), "line-counts", by="batch")
    runs = Runs(spark, documents)
    for batch in range(batches):
        runs.add(counts.where(F.col("batch") == batch))
    out = stripped(docs, runs.settled(), doc_id=doc_id, text=text, min_chars=min_chars, most=most)  # has written the settled keys
    for k in range(len(runs.runs)):
        runs.drop(k)
    return out
