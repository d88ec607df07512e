"""Images and labels on another grid: axes in the world's order, another spacing, any affine map.

Voxels are gathered in blocks that take the first layer of the next block along (a halo), so the eight corners of any place are in
one block. Tiles of the target grid are joined with the blocks that their places fall into; a task computes the places of a tile
that are in a block. Each place is in one block alone, so nothing is put together afterwards, and a task holds blocks and tiles,
never a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]
#: Places of a block along an axis without its halo, of a tile, and places computed at once.
BLOCK, TILE, TOGETHER = 32, 32, 1 << 20


class Target(NamedTuple):
    """matrix (3 x 4): from a place of the target grid to one of the source; the target's affine and shape."""

    matrix: np.ndarray
    affine: np.ndarray
    shape: tuple[int, ...]


def ordered(affine: np.ndarray, shape: tuple[int, ...]) -> Target:
    """Axes in the order and direction of the world's (RAS): of all ways to give each grid axis a world axis the one along which they run most."""
    from itertools import permutations

    share = np.abs(affine[:3, :3] / np.linalg.norm(affine[:3, :3], axis=0))
    axis = max(permutations(range(3)), key=lambda p: sum(share[p[c], c] for c in range(3)))  # the world's, of each grid axis
    move = np.zeros((4, 4))
    move[3, 3] = 1
    for c, w in enumerate(axis):
        forward = affine[w, c] > 0
        move[c, w], move[c, 3] = (1, 0) if forward else (-1, shape[c] - 1)
    return Target(move[:3], affine @ move, tuple(shape[axis.index(w)] for w in range(3)))


def respaced(affine: np.ndarray, shape: tuple[int, ...], spacing: tuple[float, float, float], upright: bool = False) -> Target:
    """ordered(), then so far apart. The grid keeps its directions and its first corner; `upright` ones run along the world's axes and begin at the least corner. There are round((n - 1) * old / new) + 1 places an axis from corner to corner."""
    first = ordered(np.asarray(affine, float), shape)
    corners = np.array([[i, j, k, 1] for i in (0, first.shape[0] - 1) for j in (0, first.shape[1] - 1) for k in (0, first.shape[2] - 1)], float).T
    out = np.eye(4)
    out[:3, :3] = np.diag(spacing) if upright else first.affine[:3, :3] / np.linalg.norm(first.affine[:3, :3], axis=0) * spacing
    places = np.linalg.solve(out[:3, :3], (first.affine @ corners)[:3])
    out[:3, 3] = out[:3, :3] @ places.min(axis=1)
    size = np.floor(np.ptp(places, axis=1) + 0.5 + 1e-9).astype(int) + 1
    return Target((np.linalg.inv(affine) @ out)[:3], out, tuple(int(n) for n in size))


def targets(scans: DataFrame, by: list[str], spacing: tuple[float, float, float], upright: bool = False) -> DataFrame:
    """(by, matrix, affine, shape, source): the grids of scans(by, affine, shape), a row each, for resampled()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [respaced(np.array(a, float).reshape(4, 4), tuple(int(n) for n in s), spacing, upright) for a, s in zip(rows["affine"], rows["shape"], strict=True)]
            yield rows[by].assign(matrix=[t.matrix.ravel() for t in found], affine=[t.affine.ravel() for t in found], shape=[list(t.shape) for t in found], source=list(rows["shape"]))

    kinds = ", ".join(f"`{c}` {t}" for c, t in scans.select(*by).dtypes)
    return scans.select(*by, "affine", "shape").mapInPandas(run, f"{kinds}, matrix array<double>, affine array<double>, shape array<int>, source array<int>")


def resampled(voxels: DataFrame, grids: DataFrame, by: list[str], *, image: str = "value", label: str = "label", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(by, x, y, z, image, label): every place of the target grids with the image by three-linear interpolation and the nearest label (halves up). grids: targets(), or any (by, matrix, shape, source).

    Places outside the source take the values at its border. Voxels that aren't stored are 0 in both; where a block has none, its places aren't rows.
    """
    low = {c: F.floor(F.col(c) / block).cast("int") for c in XYZ}
    halo = voxels.select(*by, *XYZ, F.col(image).cast("double").alias("_v"), F.col(label).cast("int").alias("_l"))
    for c in XYZ:  # the first layer of a block is the last one of the block before it
        halo = halo.withColumn(f"_b{c}", F.explode(F.when((F.pmod(F.col(c), F.lit(block)) == 0) & (F.col(c) > 0), F.array(low[c], low[c] - 1)).otherwise(F.array(low[c]))))
    key = [f"_b{c}" for c in XYZ]
    blocks = halo.groupBy(*by, *key).agg(F.collect_list(F.struct(*XYZ, "_v", "_l")).alias("_block"))  # of one block

    tiles = grids.select(*by, "matrix", "shape", "source")
    for k, c in enumerate(XYZ):
        tiles = tiles.withColumn(f"_t{c}", F.explode(F.sequence(F.lit(0), F.col("shape")[k] - 1, F.lit(tile))))
    for k, c in enumerate(XYZ):  # the blocks between the least and the greatest place along each axis
        ends = [F.col("matrix")[4 * k + 3]] * 2
        for j, d in enumerate(XYZ):
            m, first = F.col("matrix")[4 * k + j], F.col(f"_t{d}")
            last = F.least(first + tile, F.col("shape")[j]) - 1
            ends = [ends[0] + F.least(m * first, m * last), ends[1] + F.greatest(m * first, m * last)]
        at = [F.floor(F.least(F.greatest(e + slack, F.lit(0.0)), F.col("source")[k] - 1.0) / block).cast("int") for e, slack in zip(ends, (-1e-6, 1e-6), strict=True)]
        tiles = tiles.withColumn(f"_b{c}", F.explode(F.sequence(*at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            shape = np.array(rows.column("shape").to_pylist()).reshape(-1, 3)
            corner = np.stack([rows.column(f"_t{c}").to_numpy() for c in XYZ], 1).astype(np.int64)
            size = np.minimum(shape - corner, tile)
            upto = np.concatenate([[0], np.cumsum(size.prod(1))])
            i = 0
            while i < rows.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + TOGETHER, "right")) - 1)
                yield computed(rows.slice(i, j - i), corner[i:j], size[i:j])
                i = j

    def computed(rows: pa.RecordBatch, corner: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        source = np.array(rows.column("source").to_pylist()).reshape(-1, 3)
        first = np.stack([rows.column(c).to_numpy() for c in key], 1).astype(np.int64) * block
        wide = np.minimum(source - first, block + 1)  # the block as far as the grid goes
        begin = np.concatenate([[0], np.cumsum(wide.prod(1))])
        listed = rows.column("_block")
        of = np.repeat(np.arange(rows.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
        x, y, z, v, lab = (listed.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
        spot = lambda r, p: begin[r] + ((p[:, 0] - first[r, 0]) * wide[r, 1] + p[:, 1] - first[r, 1]) * wide[r, 2] + p[:, 2] - first[r, 2]
        values, labels = np.zeros(begin[-1]), np.zeros(begin[-1], np.int32)
        here = spot(of, np.stack([x, y, z], 1).astype(np.int64))
        values[here], labels[here] = np.nan_to_num(v), lab

        n = size.prod(1)
        r = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        place = corner[r] + np.stack([nth // (size[r, 1] * size[r, 2]), nth // size[r, 2] % size[r, 1], nth % size[r, 2]], 1)
        matrix = np.array(rows.column("matrix").to_pylist()).reshape(-1, 3, 4)
        p = np.einsum("nij,nj->ni", matrix[r, :, :3], place.astype(float)) + matrix[r, :, 3]
        p = np.clip(p, 0, source[r] - 1.0)
        low = np.floor(p).astype(np.int64)
        mine = (low // block == first[r] // block).all(1)
        r, place, p, low = r[mine], place[mine], p[mine], low[mine]
        share, image_at = p - low, np.zeros(len(r))
        for corners in np.ndindex(2, 2, 2):
            side = np.array(corners)
            weight = np.where(side, share, 1 - share).prod(1)
            image_at += weight * values[spot(r, np.minimum(low + side, source[r] - 1))]
        label_at = labels[spot(r, np.minimum(np.floor(p + 0.5).astype(np.int64), source[r] - 1))]
        kept = [rows.column(c).take(pa.array(r)) for c in by]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(place[:, k].astype(np.int32)) for k in range(3)), pa.array(image_at), pa.array(label_at)], names=[*by, *XYZ, image, label])

    kinds = ", ".join(f"`{c}` {t}" for c, t in voxels.select(*by).dtypes)
    # blocks hold voxels in lists, whose size is guessed far too low, and they would be broadcast
    joined = tiles.join(blocks.hint("merge"), [*by, *key]).select(*by, "matrix", "shape", "source", *[f"_t{c}" for c in XYZ], *key, "_block")
    return joined.mapInArrow(run, f"{kinds}, x int, y int, z int, `{image}` double, `{label}` int")
