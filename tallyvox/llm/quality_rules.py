"""Quality rules: counts with fixed limits, and a calibrated logistic regression over hashed n-grams.

Features are shares of a document's words, word pairs and byte trigrams in hash buckets, so a score is a sum over n-grams
divided by their number, one pass over a chunk of texts. The model is fitted on at most `fit_rows` labelled documents a
class, the first by a hash of the id, and on `fit_bytes` of their features; a quarter of these, kept aside, set the slope and offset that turn scores into
probabilities, weighted to the labels' own shares of the classes. Documents with a probability under `least` go.

Null text has no words; it fails the base rule for length, as any text of fewer than ten words does. Without labels of
both classes the model keeps everything. Repeated rows are judged alike; of those with one labelled id, the text with the
least hash is fitted on, and of several labels of one id the best. Of an empty table nothing comes out. Other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written

BUCKETS = 1 << 15
#: Labelled documents of a class that the model is fitted on, at most.
FIT_ROWS = 1500
#: Bytes of features of a class that the model is fitted on, at most.
FIT_BYTES = 64 << 20
#: Fixed limits.
MIN_WORDS, MAX_REPEAT_PERCENT, LEAST_PROBABILITY = 10, 20, 0.5
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _distinct(document: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item the number of items of its document with the same hash, and the number of different ones per document's items (as flags of the first)."""
    _, first, back, n = np.unique(tx.mix(h ^ tx.mix(document.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(h), bool)
    new[first] = True
    return n[back], new


def counts(chunk: tx.Chunk) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    buf, at = chunk.buf, chunk.at
    starts, ends, word_at = chunk.words()
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out = {"n_words": np.diff(word_at), "word_chars": tx.per_document(points[ends] - points[starts], word_at), "n_symbols": tx.per_document(SYMBOLS[buf], at)}
    # lines: cut at each newline and at the ends of documents
    newline = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([at[:-1], newline + 1]))
    begin = begin[begin < len(buf)]
    stop = np.append(begin[1:], len(buf))
    stop = stop - ((stop > begin) & (buf[stop - 1] == 10)) if len(stop) else stop
    document = np.searchsorted(at, begin, "right") - 1
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, document = begin[has], stop[has], document[has]
    _, new = _distinct(document, chunk.hashes(begin, stop))
    out["n_dup_lines"] = np.bincount(document[~new], minlength=chunk.n)
    h, first = tx.windows(chunk.hashes(starts, ends), word_at, 5)
    times, _ = _distinct(np.searchsorted(word_at, first, "right") - 1, h)
    cover = np.zeros(len(starts) + 1, np.int64)
    again = first[times > 1]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    out["n_repeat_words"] = tx.per_document(np.cumsum(cover[:-1]) > 0, word_at)
    return out


def features(chunk: tx.Chunk, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and byte trigrams: the bucket of each (in that kind's own range), and the documents' offsets."""
    starts, ends, at = chunk.words()
    h = chunk.hashes(starts, ends)
    pairs, first = tx.windows(h, at, 2)
    three, three_at = tx.trigrams(chunk.lower(), buckets)
    m = np.uint64(buckets)
    return [((h % m).astype(np.int32), at), ((pairs % m).astype(np.int32) + buckets, np.searchsorted(first, at)), (three + 2 * buckets, three_at)]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, buckets: int = BUCKETS, steps: int = 60) -> tuple[np.ndarray, float] | None:
    """(weights, offset), calibrated: sigmoid(offset + sum of weights times shares) is the probability of class 1. rows: (buckets, shares, class); prior: that of class 1."""
    y = np.array([r[2] for r in rows], float)
    aside = np.arange(len(rows)) % 4 == 3
    if not all(((y == k) & s).any() for k in (0, 1) for s in (aside, ~aside)):
        return None
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    importance = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    train = np.where(aside, 0.0, np.where(y == 1, 0.5 / y[~aside].mean(), 0.5 / (1 - y[~aside].mean())))  # even classes while fitting
    w, b, seen = np.zeros(3 * buckets), 0.0, np.full(3 * buckets, 1e-8)
    use = ~aside[row]
    i, v, r = idx[use], val[use] * 30, row[use]
    for _ in range(steps):  # AdaGrad on the whole sample
        p = 1 / (1 + np.exp(-(b + np.bincount(r, v * w[i], len(rows)))))
        error = (p - y) * train
        g = np.bincount(i, v * error[r], 3 * buckets) + 1e-3 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * error.sum() / max(1, (~aside).sum())
    score = (np.bincount(row, val * 30 * w[idx], len(rows)) + b)[aside]
    y, importance, slope, offset = y[aside], importance[aside], 1.0, 0.0
    spread = score.std() or 1.0
    x = score / spread
    for _ in range(400):  # Platt scaling, with his softened targets
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        error = (p - soft) * importance
        slope, offset = slope - 0.5 * (error * x).mean(), offset - 0.5 * error.mean()
    return w * 30 * slope / spread, b * slope / spread + offset


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Features of the labelled sample, at most 2 * fit_rows documents and 2 * fit_bytes, and the share of class 1 among all labels."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    prior = known.agg(F.avg("quality")).first()[0]
    if prior is None:
        return [], 0.5
    first = lambda k: known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = docs.join(F.broadcast(first(0).union(first(1))), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            found = []
            for d in range(chunk.n):
                ids, shares = [], []
                for b, at in features(tx.Chunk(chunk.rows.slice(d, 1), chunk.buf[chunk.at[d] : chunk.at[d + 1]], chunk.at[d : d + 2] - chunk.at[d])):
                    u, n = np.unique(b, return_counts=True)
                    ids.append(u.astype("<i4"))
                    shares.append((n / max(1, len(b))).astype("<f4"))
                found.append((np.concatenate(ids).tobytes(), np.concatenate(shares).tobytes()))
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), quality=tx.column(chunk.rows, "quality"), ids=pa.array([x[0] for x in found], pa.binary()), shares=pa.array([x[1] for x in found], pa.binary()))

    found = written(chosen.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, ids binary, shares binary"), "sample")
    upto = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")  # at most fit_rows rows a class, sizes only
    few = found.select("doc_id", "quality", F.sum(F.length("ids") + F.length("shares")).over(upto).alias("upto")).where(F.col("upto") <= fit_bytes)
    rows = found.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4").astype(float), r["quality"]) for r in rows], prior


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, probability (null without a model) and kept. labels: (doc_id, quality 0 or 1)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(*sample(docs, labels, fit_rows))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            base, score = counts(chunk), None
            if sent.value is not None:
                w, b = sent.value
                score = np.full(chunk.n, b)
                for ids, at in features(chunk):
                    score += tx.per_document(w[ids], at) / np.maximum(1, np.diff(at))
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), **{k: tx.ints(v) for k, v in base.items()}, probability=pa.nulls(chunk.n, pa.float64()) if score is None else pa.array(1 / (1 + np.exp(-score))))

    found = docs.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), "probability", (~failed & F.coalesce(F.col("probability") >= least, F.lit(True))).alias("kept"))
