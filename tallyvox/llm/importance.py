"""Importance resampling of documents towards labelled target text, by Gumbel top-k.

Two generative models over hashed n-grams (words of letters and digits, lower-cased; pairs of words, told apart by whether
the second repeats the first; byte trigrams): one of the target (documents with target labels), one of all text. The target model backs off to the raw one for n-grams whose counts the
sampling of the target explains: only those that differ by `least` in logarithm and by `deviations` standard deviations
have a ratio of their own. A document's log ratio is the sum over its words of ln P(target) - ln P(raw); so it is for pairs,
and for trigrams tempered by 1/8, as they overlap and each word has several. Weights are truncated at 1: each of the three
ratios counts as far as it is below 0, and their sum is the log importance weight. With Gumbel noise, a function of id and seed,
the k largest of weight + noise are a sample without replacement in proportion to the weights.

Raw counts are of all documents. The target counts are of at most `target_rows` labelled documents, the first by a hash of
the id. k is the number of the documents given whose weight is at least that which `keep` of the target's documents have
that the target model hasn't seen (a fifth of the labelled ones): it follows the documents, not the labels' shares.

Null and empty texts have no n-grams and weight 0 (neither better nor worse than raw text). Rows with equal keys at the
border are all kept; repeated rows with one id have one key. Without target labels all weights are 0 and all rows stay. Of
an empty table nothing comes out. Other columns are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written

#: Buckets of words, of pairs and of trigrams.
WORDS, PAIRS, TRIGRAMS = 1 << 19, 2, 1 << 16
SIZE = WORDS + PAIRS + TRIGRAMS
#: What an n-gram's ratio has to show, and the exponent of the trigrams' model.
LEAST, DEVIATIONS, TRIGRAM_SHARE = 1.4, 2.5, 0.125
#: Of target documents that the model hasn't seen, the share whose weights the cut lets pass.
KEEP = 0.995
#: Labelled documents that the target model is fitted on, at most, and one in how many is set aside for the cut.
TARGET_ROWS, ASIDE = 1 << 15, 5


def hashed(chunk: tx.Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and byte trigrams: the bucket of each (in that kind's own range), and the documents' offsets."""
    low = chunk.lower()
    starts, ends, at = low.words(tx.ALNUM)
    h = low.hashes(starts, ends)
    inside = np.ones(len(h), bool)
    inside[at[:-1][at[:-1] < len(h)]] = False  # a document's first word ends no pair
    pair = np.flatnonzero(inside)
    three, three_at = tx.trigrams(low, TRIGRAMS)
    return [
        ((h % np.uint64(WORDS)).astype(np.int32), at),
        ((h[pair] == h[pair - 1]).astype(np.int32) + WORDS, np.concatenate([[0], np.cumsum(inside)])[at]),
        (three + np.int32(WORDS + PAIRS), three_at),
    ]


def counted(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Counts of each bucket in all text and in the target's. docs: (doc_id, text); target_ids: at most TARGET_ROWS ids."""
    marked = docs.join(F.broadcast(target_ids.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int64)
        for chunk in tx.chunks(batches):
            wanted = np.flatnonzero(tx.column(chunk.rows, "target").to_numpy(zero_copy_only=False))
            for ids, at in hashed(chunk):
                total[0] += np.bincount(ids, minlength=SIZE)
                if len(wanted):
                    total[1] += np.bincount(np.concatenate([ids[at[d] : at[d + 1]] for d in wanted]), minlength=SIZE)
        found = np.flatnonzero(total[0])
        yield tx.batch(bucket=found.astype(np.int32), raw=total[0][found], target=total[1][found])

    rows = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, SIZE))
    for k, name in enumerate(("raw", "target")):  # a row a bucket at most, whatever the corpus
        out[k, rows["bucket"].to_numpy()] = rows[name].to_numpy()
    return out


def ratios(counts: np.ndarray, least: float = LEAST, deviations: float = DEVIATIONS) -> np.ndarray:
    """ln P(target) - ln P(raw) of each bucket, 0 where the target's count is what raw text of its size would have by chance (but for the two of pairs); trigrams with their exponent."""
    out = np.zeros(counts.shape[1])
    for part, share in ((slice(0, WORDS), 1.0), (slice(WORDS, WORDS + PAIRS), 1.0), (slice(WORDS + PAIRS, None), TRIGRAM_SHARE)):
        raw, target = counts[0, part], counts[1, part]
        if target.sum():
            expected = raw * target.sum() / raw.sum()
            ratio = np.log(target + 1) - np.log(expected + 1)
            told = (np.abs(ratio) >= least) & (np.abs(target - expected) >= deviations * np.sqrt(expected + 1)) if len(raw) > PAIRS else True
            out[part] = np.where(told, share * ratio, 0.0)
    return out


def gumbel(doc_id: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise of each id."""
    h = tx.mix(tx.mix(doc_id.astype(np.uint64) + np.uint64(1)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def keyed(docs: DataFrame, weight: np.ndarray, *, seed: int, doc_id: str, text: str, above: float | None = None) -> DataFrame:
    """(doc_id, log_weight, key), or with `above` the rows of docs whose key is at least that."""
    sent = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float32))  # a number for each bucket
    if above is None:
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        doc_id, text, schema = "doc_id", "text", "doc_id long, log_weight double, key double"
    else:
        schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, text):
            log_weight = np.round(sum(np.minimum(0, tx.per_document(sent.value[ids].astype(np.float64), at)) for ids, at in hashed(chunk)), 6)
            key = np.round(log_weight + gumbel(tx.column(chunk.rows, doc_id).cast(pa.int64()).fill_null(-1).to_numpy(), seed), 6)
            if above is None:
                yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), log_weight=log_weight, key=key)
            else:
                yield chunk.rows.filter(pa.array(key >= above))

    return docs.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value, exactly. Each pass counts the values between two of them in 1,024 bins and goes on with the least and largest of the bin that holds it; the driver sees counts only."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while low != high:
        slot = F.floor((F.col(column) - low) / ((high - low) / 1024))
        bins = keys.where(F.col(column).between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["slot"]):
            low, high = b["low"], b["high"]
            if k <= b["n"]:
                break
            k -= b["n"]
    return low


def select(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP, seed: int = 1, doc_id: str = "doc_id", text: str = "text", target_rows: int = TARGET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sample, kept): (doc_id, log_weight, key) of the sampled documents, and their rows of docs. labels: (doc_id, target boolean)."""
    named = labels.where("target").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(ASIDE)) == 0
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    weight = ratios(counted(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), first(named.where(~aside), target_rows)))
    how = {"seed": seed, "doc_id": doc_id, "text": text}
    keys = written(keyed(docs, weight, **how), "keys")
    unseen = written(keys.join(F.broadcast(first(named.where(aside), target_rows)), "doc_id", "left_semi").select("log_weight"), "unseen")
    n = unseen.count()
    cut = kth_largest(unseen, max(1, int(np.floor(keep * n))), "log_weight") if n else -np.inf
    k = keys.where(F.col("log_weight") >= float(cut)).count()
    bar = kth_largest(keys, k) if k else np.inf
    return keys.where(F.col("key") >= float(bar)), keyed(docs, weight, **how, above=bar)
