"""Removal of byte strings that occur more than once, with suffix arrays.

A window is `length` consecutive bytes of one document. Each window is dealt by the content of its anchor, the k bytes in
it with the least hash (the first of equals), so equal windows meet and each window is dealt once. Consecutive windows
with the same anchor travel as one segment. Segments that have a copy (by BLAKE2b of their bytes) repeat as a whole, segments
whose anchor is unique not at all. The others, and one copy of each, are sorted with those of the same anchor:

 - suffixes smaller than their successors are sorted directly, by as many bytes as a window has,
 - the larger ones are induced from them by one scan over the buckets of first bytes,
 - adjacent common prefixes tell which windows occur again.

An anchor with more than `limit` different segments is dealt anew by what its windows have in common at offsets of 32, 4
and at last single windows, so that no task holds an unbounded group and nothing is left out. A segment that has no copy
carries its place along, so only copies are joined with their places.

Long windows are looked for inside the spans of shorter ones: a string of 400 bytes that occurs again lies in one span of
strings of 200 that do.

Null and empty texts, and those shorter than a window, lose nothing. Very long texts are searched whole, with some fifteen
numbers of eight bytes a byte of the text while its segments are cut. Repeated rows are copies of each other. Bytes are
those of UTF-8; in texts handed on, characters cut in two are dropped. Other columns are passed on or not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .docs import KEY, key_of, keyed
from .scratch import written

LENGTH, ANCHOR = 400, 32
#: Strings of so many bytes are looked for first, and reported beside the longer ones.
SHORT = 200
#: Different segments of an anchor that are sorted in one task, at most.
LIMIT = 2048
#: Bytes of segments that are sorted at once.
BATCH = 1 << 19
#: A segment with more than one in so many of all copies is one of few: its places are told by a filter, not by a join on one hot key.
HOT = 512
#: A side of a join is broadcast up to so many bytes, counted before.
BROADCAST = 32 << 20


def window_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive bytes, k a multiple of 8. It deals windows out; what equals what is told by the bytes."""
    eight = np.ascontiguousarray(tx.eights(buf)[: len(buf) - 7]) * np.uint64(0xD6E8FEB86659FD93)
    eight ^= eight >> np.uint64(32)
    n = len(buf) - k + 1
    out = eight[:n].copy()
    for j in range(8, k, 8):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += eight[j : j + n]
    return tx.mix(out)


def anchored(chunk: tx.Chunk, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Segments of a chunk: (document, first window, windows, anchor's offset from the first window, anchor's hash, segment's hash)."""
    buf, at, n = chunk.buf, chunk.at, len(chunk.buf)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = window_hash(buf, k)
    place = np.arange(n - k + 1)
    bits = np.uint64(n.bit_length())
    least = (h >> bits << bits) | place.astype(np.uint64)
    size = 1
    while size * 2 <= length - k + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = length - k + 1 - size
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    begin, stop = at[:-1], at[1:] - length + 1
    full = stop > begin
    np.add.at(inside, begin[full], 1)
    np.add.at(inside, stop[full], -1)
    first = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = anchor[first]
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    begins = np.zeros(len(anchor), bool)
    begins[np.searchsorted(first, begin[full])] = True
    s = np.flatnonzero(new | begins)
    windows = np.diff(np.append(s, len(first)))
    lo, anchor = first[s], anchor[s]
    document = np.searchsorted(at, lo, "right") - 1
    return document, lo - at[document], windows, anchor - lo, h[anchor], tx.digests(buf.tobytes(), lo, lo + windows - 1 + length)


def segments(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, same, lo, run, anchor, g, seg) of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):  # some fifteen numbers a byte are held
            d, lo, windows, anchor, g, seg = anchored(chunk, length)
            d = pa.array(d)
            yield tx.batch(doc=tx.column(chunk.rows, "doc").take(d), same=tx.column(chunk.rows, "same").take(d), lo=lo.astype(np.int32), run=windows.astype(np.int32), anchor=anchor.astype(np.int32), g=tx.ints(g), seg=tx.ints(seg))

    return docs.select("doc", "same", "text").mapInArrow(run, "doc long, same long, lo int, run int, anchor int, g long, seg long")


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions of text in the order of their suffixes, by the first `depth` bytes at least. Two-stage sorting.

    Positions that follow a wanted larger-than-successor suffix, up to the next smaller one, take part in the scan too.
    """
    n = len(text)
    step = np.zeros(n, np.int8)  # whether the next byte is larger (1), smaller (-1) or equal (0)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    step[-1] = -1  # the empty suffix after the last is the smallest
    place = np.arange(n, dtype=np.int32)
    differs = np.minimum.accumulate(np.where(step != 0, place, n)[::-1])[::-1]
    small = step[differs] > 0
    used = wanted.copy()
    stop = np.minimum.accumulate(np.where(small, place, n - 1)[::-1])[::-1]  # where chains of larger suffixes end
    chain = np.flatnonzero(wanted & ~small)
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, chain, 1)
    np.add.at(reach, stop[chain] + 1, -1)
    used |= np.cumsum(reach[:-1]) > 0
    del place, differs, stop, reach, chain
    # first stage: smaller suffixes
    begin = np.flatnonzero(used & small)
    as_text = text.tobytes().decode("latin-1")
    begin = begin[np.argsort(text[begin], kind="stable")]
    cut = np.searchsorted(text[begin], np.arange(257))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # a bucket's keys at a time are held
        keys = [as_text[i : i + depth] for i in begin[a:b].tolist()]
        begin[a:b] = begin[a:b][sorted(range(len(keys)), key=keys.__getitem__)]
    # second stage: one scan over the buckets, from the least byte
    large = used & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if large[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        done = []
        todo = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(todo):  # a run of one byte induces within its own bucket
            done.append(todo)
            before = todo - 1
            todo = before[(before >= 0) & large[before] & (text[before] == c)]
        own = begin[cut[c] : cut[c + 1]]
        bucket = np.concatenate([*done, own])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[(before >= 0) & large[before]]
        first = text[before]
        go = first > c
        before, first = before[go], first[go]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edge = np.flatnonzero(np.diff(first, prepend=-1))
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(first)).tolist(), strict=True):
                waiting[first[a]].append(before[a:b])
        waiting[c] = []
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which positions share at least `length` bytes with a neighbour in the suffix order."""
    eight = np.zeros(len(text) + 8, np.uint64)
    for j in range(8):
        eight[: len(text) - j] |= text[j:].astype(np.uint64) << np.uint64(8 * j)
    left = np.arange(len(order) - 1)
    for depth in [*range(0, length - 8, 8), length - 8]:
        left = left[eight[order[left] + depth] == eight[order[left + 1] + depth]]
    out = np.zeros(len(text), bool)
    out[order[left]] = True
    out[order[left + 1]] = True
    return out


def covered(again: np.ndarray, length: int) -> np.ndarray:
    """Spans (begin, end) that windows at the marked starts cover."""
    start = np.flatnonzero(again)
    if not len(start):
        return np.zeros(0, "<i4")
    edge = np.flatnonzero(np.diff(start) > length)
    return np.stack([start[np.append(0, edge + 1)], start[np.append(edge, len(start) - 1)] + length], 1).astype("<i4").ravel()


PLACED = "g long, seg long, m long, run int, anchor int, data binary, doc long, same long, lo int"
_NAMES = ("g", "seg", "m", "run", "anchor", "data", "doc", "same", "lo")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
FOUND = "doc long, same long, lo int, size int, spans binary"


def sort_segments(rows: list[tuple], length: int) -> list[bytes]:
    """The repeated spans of each segment (g, seg, m, run, anchor, data, ...) that has no copy, from those of all."""
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])
    edge = np.zeros(len(text) + 1, np.int64)
    for a, r in zip(at.tolist(), rows, strict=False):
        edge[a] += 1
        edge[a + r[3]] -= 1
    wanted = np.cumsum(edge[:-1]) > 0
    again = repeated(text, suffix_order(text, wanted, length), length)
    return [b"" if r[2] > 1 else covered(again[a : a + r[3]], length).tobytes() for a, r in zip(at.tolist(), rows, strict=False)]


def sorted_spans(segs: DataFrame, length: int = LENGTH) -> DataFrame:
    """FOUND rows of the segments (PLACED) without a copy in which windows repeat; each anchor's segments meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = [(*r[6:9], 0, s) for r, s in zip(held, sort_segments(held, length), strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc", "same", "lo", "size", "spans"])

        for rows in batches:
            for row in zip(*(rows[c].to_pylist() for c in _NAMES), strict=True):
                if group and group[-1][0] != row[0]:
                    if len(group) > 1:  # one segment alone shares nothing
                        held += group
                        size += sum(len(r[5]) for r in group)
                    group = []
                    if size >= BATCH:
                        yield flush()
                        held, size = [], 0
                if not group or group[-1][1] != row[1]:  # else from a repeated row
                    group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield flush()

    return segs.repartition("g").sortWithinPartitions("g", "seg").mapInArrow(run, FOUND)


def pieces(segs: DataFrame, width: int, length: int = LENGTH) -> DataFrame:
    """Segments (PLACED) cut at multiples of `width` from their anchor, dealt by the bytes that all windows of a piece share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for g, _, m, windows, anchor, data, doc, same, lo in zip(*(rows[c].to_pylist() for c in _NAMES), strict=True):
                for q in range(-anchor // width, (windows - 1 - anchor) // width + 1):
                    begin, stop = max(0, anchor + q * width), min(windows, anchor + (q + 1) * width)
                    core = data[anchor + (q + 1) * width - 1 : anchor + q * width + length]
                    part = data[begin : stop - 1 + length]
                    key = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in (b"%d %d " % (g, q) + core, b"%d " % (begin - anchor) + part)]
                    out.append((*key, m, stop - begin, anchor - begin, part, doc, same, lo + begin))
            yield tx.batch(**{c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(_NAMES, _KINDS, strict=True))})

    return segs.mapInArrow(run, PLACED)


def one_each(rows: DataFrame) -> DataFrame:
    """Of equal segments (PLACED) one, with their number m; it has a place only where it has no copy."""
    some = rows.groupBy("g", "seg").agg(F.sum("m").alias("m"), *[F.first(c).alias(c) for c in _NAMES[3:]])
    return some.select("g", "seg", "m", "run", "anchor", "data", *[F.when(F.col("m") == 1, F.col(c)).alias(c) for c in ("doc", "same")], "lo")


def copied(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Those of rows (g, seg, ...) whose segment has copies. numbers: (g, seg, m), a table."""
    key, copies = F.concat_ws(":", "g", "seg"), numbers.where("m > 1").select("g", "seg", "m")
    total = copies.agg(F.sum("m")).first()[0] or 0
    hot = [f"{r['g']}:{r['seg']}" for r in copies.where(F.col("m") > total / HOT).select("g", "seg").collect()]  # fewer than HOT
    rest = rows.where(~key.isin(*hot)) if hot else rows
    found = rest.join(within(copies.where(F.col("m") <= total / HOT).select("g", "seg")), ["g", "seg"], "left_semi")
    return found.unionByName(rows.where(key.isin(*hot))) if hot else found


def resolved(segs: DataFrame, widths: tuple[int, ...] = (32, 4, 1), limit: int = LIMIT, length: int = LENGTH) -> DataFrame:
    """FOUND rows of the different segments (PLACED) that have no copy; spans are from lo, or size bytes from there."""
    crowd = segs.groupBy("g").agg(F.count_distinct("seg").alias("n")).where(F.col("n") > limit)
    crowd = written(crowd.select("g"), "crowded") if widths else None
    if crowd is None or crowd.isEmpty():
        return sorted_spans(segs, length)
    rest = sorted_spans(segs.join(crowd, "g", "left_anti"), length)
    cut = written(pieces(segs.join(crowd, "g", "left_semi").dropDuplicates(["g", "seg"]), widths[0], length), "pieces")
    one = written(one_each(cut), "segments")
    whole = copied(cut.where("m = 1"), one).select("doc", "same", "lo", (F.col("run") - 1 + length).alias("size"), F.lit(None).cast("binary").alias("spans"))
    return rest.unionByName(whole).unionByName(resolved(one, widths[1:], limit, length))


def within(df: DataFrame, payload: str | None = None) -> DataFrame:
    """df with a broadcast hint if it's small, by its counted rows and bytes."""
    size = df.agg((F.count("*") * 64 + (F.sum(F.length(payload)) if payload else F.lit(0))).alias("size")).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST else df


def repeated_spans(docs: DataFrame, limit: int = LIMIT, length: int = LENGTH) -> DataFrame:
    """(doc, same, spans): the byte spans of keyed documents that repeated windows cover; spans is a list of (lo, size, spans), each `size` bytes from lo, or spans to be shifted by lo."""
    found = written(segments(docs, length), "anchors")
    kinds = found.groupBy("g").agg(F.count("*").alias("n"), (F.min("seg") == F.max("seg")).alias("alike")).where("n > 1")
    kinds = written(kinds.select("g", "alike"), "kinds")  # as a table, so that the join can be split where one anchor has very many segments
    shared = written(found.join(kinds, "g"), "shared")
    mixed = shared.where("not alike")
    reps = mixed.groupBy("g", "seg").agg(F.count("*").alias("m"), F.min(F.struct("doc", "same", "lo", "run", "anchor")).alias("at"))
    reps = written(reps.select("g", "seg", "m", "at.*"), "different")
    pack = F.struct("g", "seg", "m", "lo", "run", "anchor")
    listed = reps.groupBy(*KEY).agg(F.collect_list(pack).alias("wanted"))  # segments of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            wanted = tx.column(chunk.rows, "wanted")
            inner = wanted.flatten()
            d = np.repeat(np.arange(chunk.n), np.diff(wanted.offsets.to_numpy()))
            lo = chunk.at[d] + inner.field("lo").to_numpy()
            stop = lo + inner.field("run").to_numpy() - 1 + length
            raw = chunk.buf.tobytes()
            alone = pa.array(inner.field("m").to_numpy() == 1)
            place = {c: pc.if_else(alone, tx.column(chunk.rows, c).take(pa.array(d)), pa.scalar(None, pa.int64())) for c in KEY}
            data = pa.array([raw[a:b] for a, b in zip(lo.tolist(), stop.tolist(), strict=True)], pa.binary())
            yield tx.batch(**{c: inner.field(c) for c in ("g", "seg", "m", "run", "anchor")}, data=data, **place, lo=inner.field("lo"))

    segs = written(docs.select(*KEY, "text").join(listed, KEY).select(*KEY, "text", "wanted").mapInArrow(cut, PLACED), "segments")
    whole = shared.where("alike").unionByName(copied(mixed, reps), allowMissingColumns=True)
    whole = whole.select(*KEY, "lo", (F.col("run") - 1 + length).alias("size"), F.lit(None).cast("binary").alias("spans"))
    both = resolved(segs, limit=limit, length=length).unionByName(whole)
    return both.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "size", "spans")).alias("spans"))  # spans of one document


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    parts = []
    for x in spans:
        if x["spans"] is None:
            parts.append(np.array([[x["lo"], x["lo"] + x["size"]]]))
        else:
            parts.append(np.frombuffer(x["spans"], "<i4").reshape(-1, 2).astype(np.int64) + x["lo"])
    both = np.concatenate(parts)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.flatnonzero(np.append(True, both[1:, 0] > reach[:-1]))
    return list(zip(both[new, 0].tolist(), reach[np.append(new[1:], len(both)) - 1].tolist(), strict=True))


def spans_of(docs: DataFrame, limit: int, length: int) -> DataFrame:
    """(doc, same, spans) of the keyed documents (with text) from which something is removed: spans as one binary of (begin, end) pairs."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = [np.array(merged(x), "<i8").tobytes() for x in rows["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["doc"], rows["same"], pa.array(both, pa.binary())], names=[*KEY, "spans"])

    found = repeated_spans(docs.select(*KEY, "text"), limit, length).mapInArrow(merge, "doc long, same long, spans binary")
    return written(found, "spans")


def parts_of(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(doc, same, text, of, lo): the bytes of each span that can hold a window, as texts with a key of their own; `of` and lo say where they are from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            raw, out = chunk.buf.tobytes(), []
            for a, doc, same, s in zip(chunk.at.tolist(), *(tx.column(chunk.rows, c).to_pylist() for c in (*KEY, "spans")), strict=False):
                for lo, stop in np.frombuffer(s, "<i8").reshape(-1, 2).tolist():
                    if stop - lo >= length:
                        out.append((doc, int.from_bytes(hashlib.blake2b(b"%d %d" % (same, lo), digest_size=8).digest(), "little", signed=True), raw[a + lo : a + stop], same, lo))
            yield tx.batch(**{c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate((("doc", pa.int64()), ("same", pa.int64()), ("text", pa.binary()), ("of", pa.int64()), ("lo", pa.int64())))})

    rows = docs.select(*KEY, "text").join(within(spans, "spans"), KEY).select(*KEY, "text", "spans")
    return written(rows.mapInArrow(cut, "doc long, same long, text binary, of long, lo long"), "parts")


def inner_spans(parts: DataFrame, limit: int, length: int) -> DataFrame:
    """(doc, same, spans) of the documents that the parts are from."""

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = [np.sort(np.concatenate([np.frombuffer(s, "<i8") + lo for lo, s in zip(los, found, strict=True)])).tobytes() for los, found in zip(rows["los"].to_pylist(), rows["found"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows["doc"], rows["same"], pa.array(both, pa.binary())], names=[*KEY, "spans"])

    found = spans_of(parts, limit, length).join(parts.select(*KEY, "of", "lo").distinct(), KEY)
    listed = found.groupBy("doc", F.col("of").alias("same")).agg(F.collect_list("lo").alias("los"), F.collect_list("spans").alias("found"))  # spans of one document
    return written(listed.mapInArrow(shift, "doc long, same long, spans binary"), "spans")


def kept_bytes(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, spans) of one text."""
    if spans is None:
        return raw, 0, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    out, last = [], 0
    for a, b in pairs:
        out.append(raw[last:a])
        last = b
    kept = b"".join([*out, raw[last:]])
    return kept, len(raw) - len(kept), len(pairs)


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and n_repeated: the bytes that strings of `short` bytes found again cover. short: at most length."""
    docs = keyed(docs, doc_id, text)
    outer = spans_of(docs, limit, short)
    inner = inner_spans(parts_of(docs, outer, length), limit, length)
    spans = written(outer.withColumnRenamed("spans", "wide").join(inner, KEY, "left"), "both")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            raw, spans, wide = chunk.buf.tobytes(), tx.column(chunk.rows, "spans").to_pylist(), tx.column(chunk.rows, "wide").to_pylist()
            rows = []
            for a, b, s, w in zip(chunk.at[:-1].tolist(), chunk.at[1:].tolist(), spans, wide, strict=True):
                kept, removed, n = kept_bytes(raw[a:b], s)
                rows.append((removed, n, hashlib.sha256(kept).hexdigest(), 0 if w is None else int(np.diff(np.frombuffer(w, "<i8").reshape(-1, 2), axis=1).sum())))
            yield tx.batch(doc_id=tx.column(chunk.rows, "doc_id"), n_bytes=np.diff(chunk.at), **{c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())))})

    found = docs.join(within(spans, "wide"), KEY, "left").select("doc_id", "text", "spans", "wide")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, length: int = LENGTH) -> DataFrame:
    """docs with the repeated strings cut out of their text; documents of which nothing is left go, others keep all columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), *[v.alias(k) for k, v in key_of(doc_id, text).items()])
    spans = spans_of(packed, limit, length)
    found = packed.join(within(spans, "spans"), KEY, "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            spans, texts = tx.column(chunk.rows, "spans").to_pylist(), tx.column(chunk.rows, "text").to_pylist()
            kept = [t if s is None else kept_bytes(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
            stays = pa.array([s is None or k != "" for s, k in zip(spans, kept, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([tx.column(chunk.rows, "row"), pa.array(kept, pa.string())], names=["row", "text"]).filter(stays)

    found = found.mapInArrow(run, found.select("row", "text").schema)
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
