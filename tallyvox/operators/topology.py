"""Connected components of masks.

Masks travel as lines of bits (`distance.lines()`). A mask of few voxels is one row, and a task labels many of them together. A
larger one is cut into blocks that share their faces: each block is labelled in a task, labels that meet in a shared voxel are
linked, and the links are contracted: in one task where they are few, else as a graph. So a task holds blocks, never a mask, whose size isn't bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .distance import lines, places

_STEPS = {6: [(1, 0, 0), (0, 1, 0), (0, 0, 1)], 26: [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]}
#: Voxels of a mask that is one task's; voxels labelled at once; the side of a block of a larger one.
VOXELS, TOGETHER, BLOCK = 1 << 22, 1 << 20, 128
#: Places of voxels in names of labels: 20 bits an axis.
HALF, BITS = 1 << 19, 20


def rooted(xyz: np.ndarray, mask: np.ndarray, connectivity: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(first, root): of each different voxel of each mask (numbered from 0) its index in xyz, in order of mask and place, and the least index into first of its component. Least labels spread over neighbour links, with pointer jumping, until nothing changes; the masks' grids lie apart."""
    if not len(xyz):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = xyz.astype(np.int64) - xyz.min(axis=0) + 1
    side = p.max(axis=0) + 2
    code, first = np.unique(((mask.astype(np.int64) * side[0] + p[:, 0]) * side[1] + p[:, 1]) * side[2] + p[:, 2], return_index=True)
    links = []
    for dx, dy, dz in _STEPS[connectivity]:
        other = code + (dx * side[1] + dy) * side[2] + dz
        at = np.minimum(np.searchsorted(code, other), len(code) - 1)
        has = code[at] == other
        links.append(np.stack([np.flatnonzero(has), at[has]], 1))
    links = np.concatenate(links)
    label = np.arange(len(code))
    while True:
        before = label.copy()
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        np.minimum.at(label, label[links[:, 0]], low)
        np.minimum.at(label, label[links[:, 1]], low)
        label = label[label]
        if (label == before).all():
            return first, label


def components(xyz: np.ndarray, mask: np.ndarray, connectivity: int = 6) -> np.ndarray:
    """The number of components of each mask (numbered from 0)."""
    first, root = rooted(xyz, mask, connectivity)
    return np.bincount(mask[first[np.unique(root)]], minlength=int(mask.max(initial=-1)) + 1)


def n_components(xyz: np.ndarray, connectivity: int = 6) -> int:
    """The number of components of one mask."""
    return int(components(xyz, np.zeros(len(xyz), np.int64), connectivity).sum())


def parts(rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, xyz, row of each from the first) of rows with lists of lines, some TOGETHER voxels at a time."""
    listed = rows.column("lines")
    at = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
    x, y, zb, own = (listed.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
    size = np.concatenate([[0], np.cumsum(np.bitwise_count(own.view(np.uint64)).astype(np.int64))])[at]
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(size, size[i] + TOGETHER, "right")) - 1)
        here = slice(at[i], at[j])
        line, xyz = places(x[here], y[here], zb[here], own[here])
        yield i, j - i, xyz, np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))[line]
        i = j


def betti0(voxels: DataFrame, by: list[str], connectivity: int = 6, most: int | None = None, block: int = BLOCK, links: int | None = None) -> DataFrame:
    """(by, betti): components of each group's voxels. Groups of more than `most` voxels (VOXELS) are labelled in blocks, the others whole. Where the blocks of a group share more than `links` voxels (VOXELS), their labels are contracted as a graph, else in one task."""
    rows = written(lines(voxels, by, {"own": F.lit(True)}))
    large = written(rows.groupBy(*by).agg(F.sum(F.bit_count("own")).alias("n")).where(F.col("n") > (VOXELS if most is None else most)).drop("n"))
    if large.isEmpty():
        return _whole(rows, by, connectivity)
    return _whole(rows.join(large, by, "left_anti"), by, connectivity).unionByName(_in_blocks(rows.join(large, by, "left_semi"), by, connectivity, block, VOXELS if links is None else links))


def _whole(rows: DataFrame, by: list[str], connectivity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for masks in batches:
            for first, n, xyz, mask in parts(masks):
                key = masks.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(key.column(c) for c in by), pa.array(components(xyz, mask, connectivity))], names=[*by, "betti"])

    listed = rows.groupBy(*by).agg(F.collect_list(F.struct("x", "y", "zb", "own")).alias("lines"))  # of a mask of few voxels
    return listed.mapInArrow(run, f"{_kinds(rows, by)}, betti long")


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*by).dtypes)


def _in_blocks(rows: DataFrame, by: list[str], connectivity: int, side: int, links: int) -> DataFrame:
    """Blocks take `side` places an axis and the first one of the next block, so that any two neighbours are together in one; labels are told apart by their least voxel and on which side of it the block lies."""
    if side >= HALF:
        raise ValueError(f"blocks of {HALF} places or more can't be told apart")

    def of(c: str):
        b = F.floor(F.col(c) / side)
        return F.explode(F.when(F.pmod(F.col(c), F.lit(side)) == 0, F.array(b, b - 1)).otherwise(F.array(b)))

    # a line of 64 places is cut to the blocks along z that it meets, their halo included; nothing is taken apart by voxel
    low, high = F.col("zb") * 64, F.col("zb") * 64 + 63
    dealt = rows.withColumn("bx", of("x")).withColumn("by_", of("y")).withColumn("bz", F.explode(F.sequence(F.floor((low - 1) / side), F.floor(high / side))))
    begin, end = F.greatest(F.col("bz") * side - low, F.lit(0)).cast("int"), F.least((F.col("bz") + 1) * side - low, F.lit(63)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - (end - begin))
    cut = dealt.where(end >= begin).withColumn("own", F.col("own").bitwiseAND(F.call_function("shiftleft", ones, begin))).where("own <> 0")
    blocks = cut.groupBy(*by, "bx", "by_", "bz").agg(F.collect_list(F.struct("x", "y", "zb", "own")).alias("lines"))  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the voxels it shares with others, with their labels, and the number of components without any."""
        for some in batches:
            corner = np.stack([some.column(c).to_numpy() for c in ("bx", "by_", "bz")], 1) * side
            for begin, n, xyz, of_block in parts(some):
                first, root = rooted(xyz, of_block, connectivity)
                block, place = of_block[first] + begin, xyz[first]
                if np.abs(place).max(initial=0) >= HALF:
                    raise ValueError(f"places beyond {HALF} can't be told apart")
                code = ((place[:, 0] + HALF << BITS) + place[:, 1] + HALF << BITS) + place[:, 2] + HALF
                behind = ((place == corner[block] + side) * [4, 2, 1]).sum(1)  # the block lies before a voxel of its far faces
                shared = np.flatnonzero((place % side == 0).any(1))
                inner = np.setdiff1d(root, root[shared])
                name = (code << 3 | behind)[root]
                upto = pa.array(np.concatenate([[0], np.cumsum(np.bincount(block[shared] - begin, minlength=n))]).astype(np.int32))  # voxels are in order of blocks
                lists = [pa.ListArray.from_arrays(upto, pa.array(x[shared])) for x in (code, name)]
                key = some.slice(begin, n)
                yield pa.RecordBatch.from_arrays([*(key.column(c) for c in by), *lists, pa.array(np.bincount(block[inner] - begin, minlength=n).astype(np.int64))], names=[*by, "places", "labels", "inner"])

    found = written(blocks.mapInArrow(run, f"{_kinds(rows, by)}, places array<long>, labels array<long>, inner long"))
    large = written(found.groupBy(*by).agg(F.sum(F.size("places")).alias("n")).where(F.col("n") > links).drop("n"))
    if large.isEmpty():
        return _met(found, by)
    whole, met = found.join(large, by, "left_semi"), found.join(large, by, "left_anti")
    inner = whole.groupBy(*by).agg(F.sum("inner").alias("n"))
    shared = whole.select(*by, F.explode(F.arrays_zip("places", "labels")).alias("v")).select(*by, F.col("v.places").alias("place"), F.col("v.labels").alias("label"))
    meet = shared.groupBy(*by, "place").agg(F.collect_set("label").alias("labels"))  # at most eight blocks share a voxel
    edges = meet.select(*by, F.explode("labels").alias("a"), F.array_min("labels").alias("b")).distinct()
    outer = links_contracted(edges, by).groupBy(*by).agg(F.count_distinct("root").alias("n"))
    return _met(met, by).unionByName(inner.unionByName(outer).groupBy(*by).agg(F.sum("n").alias("betti")))


def _met(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, betti) of groups whose blocks share few voxels: their labels are contracted in a task, of many groups together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            size = np.concatenate([[0], np.cumsum(some.column("places").value_lengths().to_numpy(zero_copy_only=False))])
            i = 0
            while i < some.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + TOGETHER, "right")) - 1)
                rows = some.slice(i, j - i)
                place, label = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("places", "labels"))
                outer = met(np.repeat(np.arange(j - i), np.diff(size[i : j + 1])), place, label, j - i)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in by), pa.array(outer + rows.column("inner").to_numpy())], names=[*by, "betti"])
                i = j

    listed = found.groupBy(*by).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("places", "labels")], F.sum("inner").alias("inner"))  # of few voxels
    return listed.mapInArrow(run, f"{_kinds(found, by)}, betti long")


def met(group: np.ndarray, place: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """The number of components of each of n groups (numbered from 0, in order): labels at one place of a group are one."""
    order = np.lexsort((label, group))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(group[order]) != 0) | (np.diff(label[order]) != 0)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    of = group[order][fresh]
    order = np.lexsort((place, group))
    same = np.flatnonzero((np.diff(group[order]) == 0) & (np.diff(place[order]) == 0))
    a, b = node[order[same]], node[order[same + 1]]
    root = np.arange(len(of))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return np.bincount(of[np.unique(root)], minlength=n)


def links_contracted(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root) for every node of links (by, a, b), also of those to itself: root is the least node of its group that links lead to.

    Each node points at the least node it has seen. In turn all pointers at a node, and the node itself, are moved to the least
    of them, and pointers are followed twice, until none changes.
    """
    edges = links.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = written(edges.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct())
    edges = written(edges.where("u <> v").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        if edges.groupBy(*by, "u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.select(*by, F.col("v").alias("u")).join(edges, [*by, "u"], "left_semi").isEmpty():
            break
    roots = edges.withColumnRenamed("u", "node")
    return nodes.join(roots, [*by, "node"], "left").select(*by, "node", F.coalesce("v", "node").alias("root"))


def betti_differences(elements: DataFrame, raters: int, organs: list[int], subject: str = "subject", connectivity: int = 6) -> DataFrame:
    """(subject, organ, consensus, raters, differences): components of each organ in the consensus and in each rater's mask, and their absolute differences. elements: labels (an array of the raters'), label (the consensus), x, y, z; an organ that a mask lacks has no component."""
    every = F.concat(F.array("label"), "labels")
    voxels = elements.select(subject, "x", "y", "z", F.posexplode(F.transform(every, lambda v: v.cast("int"))).alias("rater", "organ")).where(F.col("organ").isin(*organs))
    found = betti0(voxels, [subject, "rater", "organ"], connectivity)
    each = [F.coalesce(F.max(F.when(F.col("rater") == r, F.col("betti"))), F.lit(0)) for r in range(raters + 1)]
    rows = found.groupBy(subject, "organ").agg(each[0].alias("consensus"), F.array(*each[1:]).alias("raters"))
    return rows.withColumn("differences", F.transform("raters", lambda b: F.abs(b - F.col("consensus"))))
