"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of letters and digits, A-Z lower-cased. Each window of `span` consecutive words of a test item (a shorter
item is one window) is found by its two rarest words: corpus frequencies of the test words choose them, and the training
text's postings (word, document, position) of these words are stored. Subtracting a word's offset in its item from each of
its positions gives the place where the item would begin; lists that agree on document and place are intersected. What is
left is compared with the document's own words for exact phrases. proximity() relaxes the agreement to a distance.

Documents are told apart by id and text hash: repeated rows have the same result, rows that share an id but not the text
have their own. Null and empty texts and items have no words: no hits. Without items nothing is hit. An item without an id
hits words, but isn't counted or named. Repeated items are one. Very long texts are searched whole, some 30 bytes a word of them. Other columns of the two tables aren't read, so names can't
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .docs import KEY, key_of, keyed
from .scratch import written

if TYPE_CHECKING:
    import pandas as pd

SPAN = 10
#: Test words sent to all tasks as a filter, at most; with more, all words are counted and stored.
FILTER_WORDS = 1 << 21
#: Candidates that are sent to the documents, at most; with more, the documents are sorted and merged with them.
SENT_BYTES = 16 << 20


class Members:
    """A set of 64-bit hashes; most of those outside are told by a bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are members, and their places in hashes."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.hashes, h[at])
        hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[hit], place[hit]


def word_hashes(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    low = chunk.lower()
    starts, ends, at = low.words(tx.ALNUM)
    return low.hashes(starts, ends), at


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, n, pos, word): the words of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            h, at = word_hashes(chunk)
            n = np.diff(at)
            d = pa.array(np.repeat(np.arange(chunk.n), n))
            yield tx.batch(item=tx.column(chunk.rows, "item").take(d), item_id=tx.column(chunk.rows, "item_id").take(d), n=np.repeat(n, n), pos=np.arange(len(h)) - np.repeat(at[:-1], n), word=tx.ints(h))

    rows = items.select(F.xxhash64(F.col(item_id), F.col(text)).alias("item"), F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    return rows.dropDuplicates(["item"]).mapInArrow(run, "item long, item_id string, n long, pos long, word long")


def filter_of(words: DataFrame, most: int | None = None) -> Members | None:
    """The words, if they are few enough (FILTER_WORDS, or `most`) to be sent to every task."""
    most = FILTER_WORDS if most is None else most
    found = words.select("word").distinct().limit(most + 1).toArrow()["word"].to_numpy().view(np.uint64)
    return Members(found) if len(found) <= most else None


def frequencies(docs: DataFrame, members: Members | None) -> DataFrame:
    """(word, frequency) in the whole text of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros(len(m.hashes) if m is not None else 0, np.int64)
        for chunk in tx.chunks(batches):
            h, _ = word_hashes(chunk)
            if m is not None:
                total += np.bincount(m.find(h)[1], minlength=len(total))
            else:
                word, n = np.unique(h, return_counts=True)
                yield tx.batch(word=tx.ints(word), frequency=n)
        if m is not None:
            found = np.flatnonzero(total)
            yield tx.batch(word=tx.ints(m.hashes[found]), frequency=total[found])

    return docs.select("text").mapInArrow(run, "word long, frequency long").groupBy("word").agg(F.sum("frequency").alias("frequency"))


def rarest(words: DataFrame, frequency: DataFrame, span: int) -> DataFrame:
    """(item, n, pos, word): the positions of the two rarest words of any window."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        f, k = rows["frequency"].to_numpy(), min(span, len(rows))
        order = np.lexsort((np.arange(len(f)), f))
        rank = np.empty(len(f), np.int64)
        rank[order] = np.arange(len(f))
        seen = np.lib.stride_tricks.sliding_window_view(rank, k)
        return rows.loc[np.unique(order[np.sort(seen, axis=1)[:, :2]]), ["item", "n", "pos", "word"]]

    joined = words.join(frequency, "word", "left").select("item", "n", "pos", "word", F.coalesce("frequency", F.lit(0)).alias("frequency"))
    return joined.groupBy("item").applyInPandas(choose, "item long, n long, pos long, word long")  # a group is one test item


def postings(docs: DataFrame, members: Members | None) -> DataFrame:
    """The index: (word, doc, same, pos) of the members, or of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            h, at = word_hashes(chunk)
            i = sent.value.find(h)[0] if sent.value is not None else np.arange(len(h))
            d = np.searchsorted(at, i, "right") - 1
            yield tx.batch(word=tx.ints(h[i]), doc=tx.column(chunk.rows, "doc").take(pa.array(d)), same=tx.column(chunk.rows, "same").take(pa.array(d)), pos=i - at[d])

    return docs.select("doc", "same", "text").mapInArrow(run, "word long, doc long, same long, pos long")


class Index:
    """The stored postings of the rarest words of `items` in `docs`."""

    def __init__(self, docs: DataFrame, items: DataFrame, *, span: int = SPAN, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"):
        self.docs, self.span = keyed(docs, doc_id, text), span
        self.words = written(item_words(items, item_id, item_text), "item-words")
        self.chosen = written(rarest(self.words, frequencies(self.docs, filter_of(self.words)), span), "rarest")
        self.postings = written(postings(self.docs, filter_of(self.chosen)), "postings")

    def placed(self) -> DataFrame:
        """(item, n, pos, doc, same, begin): where the item would begin for this word of it to stand where it does."""
        return self.postings.withColumnRenamed("pos", "found").join(self.chosen, "word").select("item", "n", "pos", *KEY, (F.col("found") - F.col("pos")).alias("begin"))

    def phrases(self) -> DataFrame:
        """(doc, same, item, begin) where the postings of at least two rarest words of the item agree (one, for an item of one word)."""
        agreed = self.placed().groupBy("item", *KEY, "begin").agg(F.count_distinct("pos").alias("words"), F.max("n").alias("n"))
        return agreed.where("words >= least(2, n)").select(*KEY, "item", "begin")

    def proximity(self, distance: int = 5, words: int = 2) -> DataFrame:
        """(doc_id, item_id, words): documents with at least so many of an item's rarest words, each within `distance` of where the others put the item."""
        near = self.placed().select("item", *KEY, "pos", F.explode(F.array(F.floor(F.col("begin") / (2 * distance)), F.floor((F.col("begin") + distance) / (2 * distance)) + F.lit(0.5))).alias("slot"))
        most = near.groupBy("item", *KEY, "slot").agg(F.count_distinct("pos").alias("words")).groupBy("item", *KEY).agg(F.max("words").alias("words"))
        return most.where(F.col("words") >= words).join(self.words.select("item", "item_id").distinct(), "item").select(F.nullif(F.col("doc"), F.lit(-(2**63))).alias("doc_id"), "item_id", "words")

    def candidates(self) -> DataFrame:
        """(doc, same, found): the candidate phrases of each document that has any, with the items' words."""
        listed = self.words.groupBy("item").agg(F.first("item_id").alias("item_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
        found = self.phrases().join(listed, "item").groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "begin", "words")).alias("found"))  # what one document's own words agree with
        return written(found, "found")

    def sent(self) -> DataFrame:
        """candidates() for a join with the documents: sent to all tasks where they are few, by their counted bytes, so that no text moves; else for a merge join."""
        found = self.candidates()
        size = found.agg(F.sum(F.aggregate("found", F.lit(64).cast("long"), lambda n, x: n + 8 * F.size(x["words"]) + 64))).first()[0] or 0
        return F.broadcast(found) if size <= SENT_BYTES else found.hint("merge")

    def matches(self) -> DataFrame:
        """(doc_id, text, found): each document and the candidate phrases in it, null where there are none."""
        return self.docs.join(self.sent(), KEY, "left").select("doc_id", "text", "found")


def hits(h: np.ndarray, found: list[tuple[str, int, np.ndarray]], span: int) -> tuple[np.ndarray, set[str]]:
    """Which words of one document lie in a window of an item, and the items."""
    hit, items = np.zeros(len(h), bool), set()
    for item_id, begin, words in found:
        k = min(span, len(words))
        lo, hi = max(0, -begin), min(len(words), len(h) - begin)
        if hi - lo < k:
            continue
        same = np.concatenate([[0], np.cumsum(h[begin + lo : begin + hi] == words[lo:hi])])
        full = np.flatnonzero(same[k:] - same[:-k] == k)
        if len(full):
            if item_id is not None:
                items.add(item_id)
            for j in range(k):
                hit[begin + lo + full + j] = True
    return hit, items


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = Index(docs, items, **options)
    span = index.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for chunk in tx.chunks(batches):
            h, at = word_hashes(chunk)
            n_hit, n_items, digest = np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64), [none] * chunk.n
            found = tx.column(chunk.rows, "found")
            for d in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                some = [(x["item_id"], x["begin"], np.array(x["words"], np.int64).view(np.uint64)) for x in found[int(d)].as_py()]
                hit, names = hits(h[at[d] : at[d + 1]], some, span)
                n_hit[d], n_items[d] = hit.sum(), len(names)
                digest[d] = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), n_words=np.diff(at), n_hit=n_hit, n_items=n_items, items_sha256=pa.array(digest), contaminated=n_hit > 0)

    return index.matches().mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs (all columns) without the contaminated ones."""
    found = Index(docs, items, doc_id=doc_id, text=text, **options).sent()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), *[v.alias(k) for k, v in key_of(doc_id, text).items()]).join(found, KEY, "left").select("row", "text", "found")
    span = options.get("span", SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            hit = np.zeros(chunk.n, bool)
            found = tx.column(chunk.rows, "found")
            maybe = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(maybe):
                h, at = word_hashes(chunk)
                for d in maybe:
                    some = [(x["item_id"], x["begin"], np.array(x["words"], np.int64).view(np.uint64)) for x in found[int(d)].as_py()]
                    hit[d] = hits(h[at[d] : at[d + 1]], some, span)[0].any()
            yield chunk.rows.select(["row"]).filter(pa.array(~hit))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
