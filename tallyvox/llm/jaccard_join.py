"""N-gram Jaccard join by a token-group matrix: exact links between sets of word shingles, and their components.

Equal sets are one node. Tokens are ordered by (frequent or not, hash); any order that all sets share gives right results,
and frequent tokens last keeps lists short. Sets that overlap by the wanted share have at least two tokens in common among
the first n - ceil(share * n) + 2 of each (one, for sets of one token). These tokens only are stored.

 1. Sets are compared with the head of each of their minhash bands, a linear number of pairs; links found here join most
    copies of a text into one component.
 2. A token's pivot is the least set that has it. Sets with the same best pivot (and component, if it has several sets) form groups of about `block` sets. The matrix
    holds each group's token union. A query opens a group only if enough of its tokens are in the union and the group
    isn't wholly of the query's own component. In an opened group a parity sketch bounds each pair's difference from below,
    inside the join, so that only pairs that can link become rows.
 3. What passes is compared on the whole sets.

Null and empty texts have no set: no links, their own id as component. Rows with a null id take part; a component's id is
the least that isn't null. Repeated rows are copies. Columns other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .docs import KEY, key_of, keyed
from .graph import components
from .scratch import written

#: Sets that have a token in their first ones, from which it counts as frequent.
FREQUENT = 32
#: Bits of the filters of frequent tokens and of wanted sets. They are of fixed size; a full one costs time, not results.
FREQUENT_BITS, WANTED_BITS = 1 << 23, 1 << 24
SKETCH_BITS = 1024
BLOCK = 64


def token_sets(chunk: tx.Chunk, shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes, their number, and a hash of the set (0 for none)."""
    low = chunk.lower()
    starts, ends, at = low.words()
    h = low.hashes(starts, ends)
    s, first = tx.windows(h, at, shingle)
    s_at = np.searchsorted(first, at)
    sets = [np.unique(s[a:b]) for a, b in zip(s_at[:-1].tolist(), s_at[1:].tolist(), strict=True)]
    short, one = tx.whole(h, at, shingle)
    for d, x in zip(short.tolist(), one, strict=True):
        sets[d] = np.array([x], np.uint64)
    n = np.array([len(x) for x in sets], np.int64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(np.concatenate(sets) + np.uint64(0x51ED270B)) if n.sum() else np.zeros(0, np.uint64))])
    edge = np.concatenate([[0], np.cumsum(n)])
    fp = np.where(n > 0, tx.mix(upto[edge[1:]] - upto[edge[:-1]] + n.astype(np.uint64)), np.uint64(0))
    return sets, n, fp


def bands(sets: list[np.ndarray], n: np.ndarray) -> pa.Array:
    """Keys that similar sets are likely to share: hashes of the least tokens of four and of eight of 64 ranges; none where fewer than half of a key's ranges have a token."""
    token, document = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    place = document * 64 + (token >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    least = np.zeros(len(n) * 64, np.uint64)
    least[place[first]] = token[first]
    keys, full = [], []
    for width in (4, 8):
        part = least.reshape(len(n), 64 // width, width)
        key = np.broadcast_to(np.arange(64 // width, dtype=np.uint64) + np.uint64(width << 8), part.shape[:2]).copy()
        for j in range(width):
            key = tx.mix(key * np.uint64(0xD6E8FEB86659FD93) + part[:, :, j])
        keys.append(key)
        full.append((part > 0).sum(axis=2) >= width // 2)
    key, full = np.concatenate(keys, axis=1), np.concatenate(full, axis=1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full.sum(axis=1))]).astype(np.int32)), tx.ints(key[full]))


def nodes(docs: DataFrame, shingle: int, percent: int, often: np.ndarray) -> DataFrame:
    """(doc_id, doc, same, fp, n, rare, sketch, bands): sketch has for each of 1024 token classes whether their number is odd; rare is the share of infrequent ones among the first tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            sets, n, fp = token_sets(chunk, shingle)
            slot = np.repeat(np.arange(chunk.n) * SKETCH_BITS, n) + (np.concatenate(sets) % np.uint64(SKETCH_BITS)).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
            odd = (np.bincount(slot, minlength=chunk.n * SKETCH_BITS) & 1).astype(np.uint8)
            words = np.packbits(odd).view(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(chunk.n + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words))
            rare = np.array([1 - has(sent.value, s[: _first(len(s), percent)]).mean() if len(s) else 1.0 for s in sets])
            yield tx.batch(**{c: tx.column(chunk.rows, c) for c in ("doc_id", *KEY)}, fp=tx.ints(fp), n=n, rare=rare, sketch=sketch, bands=bands(sets, n))

    return docs.select("doc_id", *KEY, "text").mapInArrow(run, "doc_id long, doc long, same long, fp long, n long, rare double, sketch array<long>, bands array<long>")


def _prefix(n: int, percent: int) -> int:
    need = -(-percent * n // 100)
    return n - need + min(2, need)


def _first(n: int, percent: int) -> int:
    """How many of a set's least tokens are counted."""
    return min(n, _prefix(n, percent) * 3 // 2)


def frequent(docs: DataFrame, shingle: int, percent: int) -> np.ndarray:
    """A filter of the tokens that are among the first (by hash) of more than FREQUENT sets, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in tx.chunks(batches):
            sets, n, fp = token_sets(chunk, shingle)
            some = []
            for s, k, name in zip(sets, n.tolist(), fp.tolist(), strict=True):
                if k and name not in seen:
                    seen.add(name)
                    some.append(s[: _first(k, percent)])
            if some:
                token, count = np.unique(np.concatenate(some), return_counts=True)
                yield tx.batch(token=tx.ints(token), count=count.astype(np.int32))

    counts = docs.select("text").mapInArrow(run, "token long, count int").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") > FREQUENT)
    return bits_of(counts.select("token"), FREQUENT_BITS)


def bits_of(tokens: DataFrame, size: int) -> np.ndarray:
    """Tokens as a filter of `size` bits: what reaches the driver is of that size at most."""
    place = f"pmod({tokens.columns[0]}, {size})"
    rows = tokens.selectExpr(f"cast({place} div 64 as int) as word", f"shiftleft(1L, cast({place} % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h % np.uint64(len(bits) * 64)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def stored_tokens(docs: DataFrame, shingle: int, percent: int, often: np.ndarray) -> DataFrame:
    """(token, fp, n): the first tokens of each set, infrequent ones first."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in tx.chunks(batches):
            sets, n, fp = token_sets(chunk, shingle)
            some, names, sizes = [], [], []
            for s, k, name in zip(sets, n.tolist(), fp, strict=True):
                if k and int(name) not in seen:
                    seen.add(int(name))
                    late = has(sent.value, s)
                    some.append(np.concatenate([s[~late], s[late]])[: _prefix(k, percent)])
                    names.append(name)
                    sizes.append(k)
            if some:
                each = [len(x) for x in some]
                yield tx.batch(token=tx.ints(np.concatenate(some)), fp=tx.ints(np.repeat(np.array(names, np.uint64), each)), n=np.repeat(np.array(sizes), each))

    return docs.select("text").mapInArrow(run, "token long, fp long, n long")


def can_link(n1: Column, n2: Column, s1: Column, s2: Column, percent: int) -> Column:
    """Whether sizes and sketches allow the wanted share: each odd class is at least one token of difference."""
    apart = sum((F.bit_count(F.get(s1, F.lit(i)).bitwiseXOR(F.get(s2, F.lit(i)))) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.get(s1, F.lit(0)).bitwiseXOR(F.get(s2, F.lit(0)))))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * apart <= (100 - percent) * (n1 + n2))


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link, by their whole sets. A wanted set comes from one of its documents: the others aren't tokenized again."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(wanted, WANTED_BITS))
    holders = members.where("n > 0").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc").alias("doc"))
    held = docs.sparkSession.sparkContext.broadcast(bits_of(holders.select("doc"), WANTED_BITS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in tx.chunks(rows.filter(pa.array(has(held.value, rows["doc"].to_numpy().view(np.uint64)))) for rows in batches):
            sets, n, fp = token_sets(chunk, shingle)
            keep = [d for d in np.flatnonzero(has(sent.value, fp) & (n > 0)).tolist() if int(fp[d]) not in seen and not seen.add(int(fp[d]))]
            if keep:
                yield tx.batch(fp=tx.ints(fp[keep]), tokens=pa.array([sets[d].tobytes() for d in keep], pa.binary()))

    whole = docs.select("doc", "text").mapInArrow(gather, "fp long, tokens binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])
    whole = written(whole, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ok = []
            for x, y in zip(rows["x"], rows["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([rows["a"], rows["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = whole.select(F.col("fp").alias("a"), F.col("tokens").alias("x")), whole.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """(doc_id, doc, same, n_shingles, component_id, root) of each document; root names the component (null without words)."""
    docs = keyed(docs, doc_id, text)
    often = frequent(docs, shingle, percent)
    members = written(nodes(docs, shingle, percent, often), "nodes")
    sets = written(members.where("n > 0").groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n", "rare", "sketch", "bands")]), "sets")
    stored = written(stored_tokens(docs, shingle, percent, often), "tokens")

    # 1: each set and the heads of its bands; of those that it can link to, the first and the nearest. The head is the set
    # with the fewest rare tokens: of copies with changes, the least changed one, to which most others can link
    rank = F.struct("rare", "fp")
    keys = sets.select(rank.alias("set"), F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("set").alias("head"), F.max("set").alias("other")).where("head <> other").select("key", "head")
    first = keys.join(heads, "key").where("set <> head").groupBy(F.col("set.fp").alias("fp"), F.col("head.fp").alias("pivot")).agg(F.count("*").alias("c"), F.first("head").alias("head"))
    one, two = sets.select("fp", "n", "sketch"), sets.select(F.col("fp").alias("pivot"), F.col("n").alias("pn"), F.col("sketch").alias("ps"))
    first = first.join(one, "fp").join(two, "pivot").where(can_link(F.col("n"), F.col("pn"), F.col("sketch"), F.col("ps"), percent))
    first = first.groupBy("fp").agg(F.min("head").alias("least"), F.max(F.struct("c", "pivot")).alias("nearest")).select("fp", F.explode(F.array_distinct(F.array("least.fp", "nearest.pivot"))).alias("pivot"))
    first = first.select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    links = verified(docs, members, first, shingle, percent)
    roots = written(components(links), "roots")

    # 2: groups and their token unions
    pivots = stored.groupBy("token").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other")).where("pivot <> other").select("token", "pivot")
    shared = written(stored.join(pivots, "token"), "shared")
    near = shared.groupBy("fp", "pivot").agg(F.count("*").alias("c"))
    best = near.groupBy("fp").agg(F.max(F.struct("c", F.col("pivot"))).alias("m")).select("fp", F.col("m.pivot").alias("pivot"))
    placed = best.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "pivot", F.coalesce("root", "fp").alias("comp"), F.coalesce("root", F.lit(0)).alias("own"))
    placed = written(placed, "placed")
    many = written(placed.groupBy("pivot", "own").agg(F.ceil(F.count("*") / block).alias("blocks")), "many")  # sums as tables, so that joins with them can be split
    grouped = written(placed.join(many, ["pivot", "own"]).select("fp", "comp", F.xxhash64("pivot", "own", F.pmod(F.xxhash64("fp"), "blocks")).alias("gid")).join(sets.drop("bands", "rare"), "fp"), "groups")
    rows = written(shared.select("token", "fp", "n").join(grouped.select("fp", "comp", "gid"), "fp"), "matrix-rows")
    open_ = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    rows = rows.join(open_, "token")
    matrix = rows.groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    q, g = rows.alias("q"), matrix.alias("g")
    fits = F.expr(f"q.token = g.token and q.gid <= g.gid and not (g.c0 = g.c1 and g.c0 = q.comp) and 100 * g.hi >= {percent} * q.n and {percent} * g.lo <= 100 * q.n")
    bound = q.join(g, fits).groupBy("q.fp", "g.gid").agg(F.count("*").alias("c"), F.least(F.first("q.n"), F.min("g.lo")).alias("least"))
    opened = bound.where("c >= least(2, least)").select("fp", "gid")
    one = grouped.select("fp", F.col("comp").alias("comp1"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = grouped.select("gid", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    x, y = opened.join(one, "fp").alias("x"), two.alias("y")
    pairs = x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("comp1") != F.col("comp2")) & can_link(F.col("n1"), F.col("n2"), F.col("s1"), F.col("s2"), percent))
    pairs = pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()

    # 3: links between components
    more = verified(docs, members, pairs, shingle, percent)
    comp = grouped.select("fp", "comp")
    across = more.join(comp.select(F.col("fp").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("fp").alias("b"), F.col("comp").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    over = components(across)
    final = comp.join(over.select(F.col("node").alias("comp"), "root"), "comp", "left").select("fp", F.coalesce("root", "comp").alias("root"))
    ids = members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id")).join(final, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    ids = written(ids, "ids")
    least = written(ids.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = written(ids.join(least, "root").select("fp", "component_id", "root"), "named")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(named, "fp", "left").select("doc_id", *KEY, F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each component: that with the least id (of several with this id the one with the least text hash, of repeated rows one).

    Documents without words have no component; each stays. So does one document of a component whose ids are all null.
    """
    found = join(docs, doc_id=doc_id, text=text, **options)
    times = found.groupBy(*KEY).agg(F.first("root").alias("root"), F.first(F.col("doc_id").isNull()).alias("unnamed"), F.count("*").alias("times"))
    first = times.where("root is not null").groupBy("root").agg(F.min(F.struct("unnamed", *KEY, "times")).alias("first")).select("first.doc", "first.same", (F.col("first.times") > 1).alias("repeated"))
    stays = written(first.unionByName(times.where("root is null").select(*KEY, F.lit(False).alias("repeated"))), "stays")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[v.alias(k) for k, v in key_of(doc_id, text).items()])
    once = rows.join(stays.where("not repeated").select(*KEY), KEY, "left_semi").select("row")
    repeated = rows.join(stays.where("repeated").select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
