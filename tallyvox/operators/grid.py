"""Operations on voxel grids as coordinate arithmetic and equi-joins."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]
#: Places of a target grid that are gathered in a row; what bounds of places are widened by, so that the exact test alone decides.
TILE, SLACK = 4096, 1e-6


def target_grid(groups: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Every position of a grid for each group; exploded axis by axis in the row, so nothing is joined."""
    out = groups
    for c, n in zip(XYZ, shape, strict=True):
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def resize_nearest(voxels: DataFrame, by: list[str], source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """(by, x, y, z, label) on the target grid: the source voxel at floor(position * S / T). Only positions that read a stored voxel are rows."""
    rows = voxels
    for c, s, t in zip(XYZ, source, target, strict=True):
        # target positions d with floor(d * s / t) = c: those from ceil(c * t / s) to ceil((c + 1) * t / s) - 1
        first, last = F.ceil(F.col(c) * t / s).cast("int"), (F.ceil((F.col(c) + 1) * t / s) - 1).cast("int")
        rows = rows.withColumn(f"_{c}", F.when(first <= last, F.sequence(first, last))).withColumn(f"_{c}", F.explode(f"_{c}"))
    return rows.select(*by, *[F.col(f"_{c}").alias(c) for c in XYZ], "label").where(" and ".join(f"{c} < {t}" for c, t in zip(XYZ, target, strict=True)))


def read_by(voxels: DataFrame, matrix: list[list[float]], offset: list[float], target: tuple[int, int, int]) -> DataFrame:
    """voxels (at sx, sy, sz) with x, y, z: a row for each place of the target grid whose matrix * position + offset is nearest to the voxel.

    Axis by axis come the places that can read it, by each row of the matrix and, where there is one, by its inverse; the rounded position decides.
    """
    inverse = np.linalg.inv(matrix) if np.linalg.cond(matrix) < 1e4 else None
    rows, half = voxels, 0.5 + SLACK
    for i, (c, n) in enumerate(zip(XYZ, target, strict=True)):
        first, last = [F.lit(0)] * 2, [F.lit(n - 1)] * 2
        for d, row, o in zip(XYZ, matrix, offset, strict=True):
            if row[i]:  # what the places already there leave of sx, sy or sz, for any places of the axes to come
                left = F.col(f"s{d}") - sum((F.col(e) * m for e, m in zip(XYZ[:i], row[:i], strict=True)), F.lit(o))
                rest = [m * (k - 1) for m, k in zip(row[i + 1 :], target[i + 1 :], strict=True)]
                low, high = [(left - sum(max(m, 0) for m in rest) - half) / row[i], (left - sum(min(m, 0) for m in rest) + half) / row[i]][:: 1 if row[i] > 0 else -1]
                first, last = [*first, F.ceil(low - SLACK)], [*last, F.floor(high + SLACK)]
        if inverse is not None:
            middle, wide = sum(((F.col(f"s{d}") - o) * float(m) for d, o, m in zip(XYZ, offset, inverse[i], strict=True)), F.lit(0.0)), half * float(np.abs(inverse[i]).sum()) + SLACK
            first, last = [*first, F.ceil(middle - wide)], [*last, F.floor(middle + wide)]
        rows = rows.withColumns({"_first": F.greatest(*first), "_last": F.least(*last)}).withColumn(c, F.explode(F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))))
    at = [F.round(sum((F.col(c) * m for c, m in zip(XYZ, row, strict=True)), F.lit(o))) for row, o in zip(matrix, offset, strict=True)]
    return rows.where((F.col("sx") == at[0]) & (F.col("sy") == at[1]) & (F.col("sz") == at[2])).drop("_first", "_last")


def resample_affine(voxels: DataFrame, groups: DataFrame, by: list[str], matrix: list[list[float]], offset: list[float], target: tuple[int, int, int], tile: int = TILE) -> DataFrame:
    """(by, x, y, z, label): label of the source voxel nearest to matrix * position + offset, 0 outside. Halves go away from zero. groups: a row each.

    Voxels go to the places that read them, and those of a tile, so many places in a row of the target grid, are gathered in one row; the tile's
    other places are made from it. So only places that read a voxel are moved, at most once, and nothing is joined.
    """
    source = voxels.select(*by, *[F.col(c).alias(f"s{c}") for c in XYZ], "label")
    for c in by:  # equal to nothing
        source = source.where(F.col(c).isNotNull())
    nx, ny, nz = target
    place = (F.col("x").cast("long") * ny + F.col("y")) * nz + F.col("z")
    read = read_by(source, matrix, offset, target).withColumn("_p", place).select(*by, F.floor(F.col("_p") / tile).alias("_tile"), F.struct((F.col("_p") % tile).cast("int").alias("place"), "label").alias("_read"))
    asked = groups.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((nx * ny * nz - 1) // tile).cast("long"))).alias("_tile"), F.lit(None).cast(read.schema["_read"].dataType).alias("_read"))
    tiles = read.unionByName(asked).groupBy(*by, "_tile").agg(F.collect_list("_read").alias("_read"), F.bool_or(F.col("_read").isNull()).alias("_asked")).where("_asked")
    every = F.sequence(F.lit(0), (F.least(F.lit(tile), nx * ny * nz - F.col("_tile") * tile) - 1).cast("int"))
    out = tiles.select(*by, "_tile", "_read", F.posexplode(F.concat("_read.place", F.array_except(every, F.col("_read.place")))).alias("_n", "_p"))
    p = F.col("_tile") * tile + F.col("_p")
    at = [F.floor(p / (ny * nz)), F.floor(p / nz) % ny, p % nz]
    return out.select(*by, *[a.cast("int").alias(c) for c, a in zip(XYZ, at, strict=True)], F.coalesce(F.get("_read", F.col("_n"))["label"], F.lit(0)).alias("label"))


def resize_linear(values: DataFrame, by: list[str], source: tuple[int, int, int], target: tuple[int, int, int], value: str = "p") -> DataFrame:
    """(by, x, y, z, value): trilinear, at ((d + 0.5) * S / T - 0.5) held at 0 or more. Each source place is listed under the target places whose corner it is, axis by axis in the row, so nothing is joined; the sum is by position."""
    rows, weight = values, F.lit(1.0)
    for c, s, t in zip(XYZ, source, target, strict=True):
        asked: list[dict[int, float]] = [{} for _ in range(s)]  # of each source place the target places and their weights
        for d in range(t):
            at = max((d + 0.5) * s / t - 0.5, 0.0)
            low = int(at)
            for place, w in ((low, 1 - (at - low)), (min(low + 1, s - 1), at - low)):
                asked[place][d] = asked[place].get(d, 0.0) + w
        listed = F.from_json(F.lit(json.dumps([[{"d": d, "w": w} for d, w in a.items()] for a in asked])), "array<array<struct<d: int, w: double>>>")  # a constant, as long as the axis
        rows = rows.withColumn(f"_{c}", F.explode(F.get(listed, F.col(c))))
        weight = weight * F.col(f"_{c}.w")
    return rows.groupBy(*by, *[F.col(f"_{c}.d").alias(c) for c in XYZ]).agg(F.sum(weight * F.col(value)).alias(value))


def flip(voxels: DataFrame, axes: tuple[bool, bool, bool], shape: tuple[int, int, int]) -> DataFrame:
    return voxels.withColumns({c: n - 1 - F.col(c) for c, n, on in zip(XYZ, shape, axes, strict=True) if on})


def crop(voxels: DataFrame, box: DataFrame, by: list[str], margin: int = 20) -> DataFrame:
    """voxels within the bounding box of `box`'s voxels and a margin. The join's side has one row a group; neither side is broadcast, as there may be many groups and sizes of exploded rows are guessed far too low."""
    edge = box.groupBy(*by).agg(*[f(c).alias(f"_{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & F.col(c).between(F.col(f"_lo{c}") - margin, F.col(f"_hi{c}") + margin)
    return voxels.join(edge.hint("merge"), by).where(inside).select(*voxels.columns)


def best_orientation(gt: DataFrame, pred: DataFrame, by: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(by, flip, score): of the eight flips of pred that with the largest sum of organ Dice, the first of equals. gt, pred: (by, x, y, z, label).

    The eight images of a place are gathered under the one nearest to the origin, of both masks at once; which flips lead from a
    predicted voxel to a true one follows from the sides of the middle they lie on. So each voxel moves once, and nothing is joined.
    """
    side = sum((F.when(2 * F.col(c) > n - 1, 1 << b).otherwise(0) for b, (c, n) in enumerate(zip(XYZ, shape, strict=True))), F.lit(0))
    middle = sum((F.when(2 * F.col(f"_{c}") == n - 1, 1 << b).otherwise(0) for b, (c, n) in enumerate(zip(XYZ, shape, strict=True))), F.lit(0))  # alike under either flip
    rows = gt.select(*by, *XYZ, "label", F.lit(True).alias("_gt")).unionByName(pred.select(*by, *XYZ, "label", F.lit(False).alias("_gt")))
    near = [F.least(F.col(c), n - 1 - F.col(c)).alias(f"_{c}") for c, n in zip(XYZ, shape, strict=True)]
    here = F.struct(side.alias("side"), "label")
    orbits = rows.groupBy(*by, *near).agg(F.collect_list(F.when(F.col("_gt"), here)).alias("g"), F.collect_list(F.when(~F.col("_gt"), here)).alias("p"))  # at most eight places
    met = orbits.select(*by, middle.alias("_m"), F.explode("p").alias("p"), "g").select(*by, "_m", "p", F.explode(F.filter("g", lambda g: g["label"] == F.col("p.label"))).alias("g"))
    flips = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda f: f.bitwiseXOR(F.col("p.side")).bitwiseXOR(F.col("g.side")).bitwiseAND(F.bitwise_not(F.col("_m"))) == 0)
    hit = met.select(*by, F.explode(flips).alias("flip"), F.col("g.label").alias("label")).groupBy(*by, "flip", "label").agg(F.count("*").alias("tp"))
    sizes = rows.groupBy(*by, "label").agg(F.count("*").alias("n"))
    every = sizes.withColumn("flip", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(*by, "flip", "label", F.lit(0).cast("long").alias("tp"), "n")
    both = every.unionByName(hit.withColumn("n", F.lit(0).cast("long"))).groupBy(*by, "flip", "label").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    score = both.groupBy(*by, "flip").agg(F.round(F.sum(2 * F.col("tp") / F.col("n")), 9).alias("score"))
    return score.groupBy(*by).agg(F.max(F.struct("score", (-F.col("flip")).alias("f"))).alias("m")).select(*by, (-F.col("m.f")).alias("flip"), F.col("m.score").alias("score"))


def tiles(shape: tuple[int, int, int], size: int = 96, overlap: float = 0.25) -> list[tuple[int, int, int]]:
    """Begins of sliding windows: steps of size * (1 - overlap), the last window flush with the end."""
    axes = []
    for n in shape:
        step = max(1, int(size * (1 - overlap)))
        last = max(0, n - size)
        axes.append(sorted({min(i, last) for i in range(0, last + step, step)}))
    return [(x, y, z) for x in axes[0] for y in axes[1] for z in axes[2]]


def tiled(scans: DataFrame, size: int = 96, overlap: float = 0.25, shape: str = "shape") -> DataFrame:
    """A row for each window of each scan (with an array column of its shape): x0, y0, z0."""
    step = max(1, int(size * (1 - overlap)))
    out = scans
    for i, c in enumerate(XYZ):
        last = F.greatest(F.lit(0), F.col(shape)[i] - size)
        begins = F.array_distinct(F.transform(F.sequence(F.lit(0), last + step - 1, F.lit(step)), lambda v: F.least(v, F.greatest(F.lit(0), F.col(shape)[i] - size))))  # noqa: B023
        out = out.withColumn(f"{c}0", F.explode(begins))
    return out


def depth_split(voxels: DataFrame, depth: int, source: int, below: int, above: int) -> DataFrame:
    """The class `source` becomes `below` in the lower half of the depth, `above` in the upper."""
    return voxels.withColumn("label", F.when(F.col("label") == source, F.when(F.col("z") < depth // 2, below).otherwise(above)).otherwise(F.col("label")))


def foreground_cropped(voxels: DataFrame, by: list[str]) -> DataFrame:
    """voxels moved so that their group's bounding box begins at 0, with its shape in sx, sy, sz."""
    edge = voxels.groupBy(*by).agg(*[F.min(c).alias(f"_{c}") for c in XYZ], *[(F.max(c) - F.min(c) + 1).alias(f"s{c}") for c in XYZ])
    return voxels.join(edge.hint("merge"), by).select(*[c for c in voxels.columns if c not in XYZ], *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in XYZ], *[f"s{c}" for c in XYZ])


def padded(voxels: DataFrame, roi: tuple[int, int, int]) -> DataFrame:
    """voxels (with sx, sy, sz) of grids padded to at least `roi`, half of it before (rounded down): background isn't stored, so only places and shapes change."""
    short = {c: F.greatest(F.lit(0), F.lit(n) - F.col(f"s{c}")) for c, n in zip(XYZ, roi, strict=True)}
    moved = {c: (F.col(c) + F.floor(short[c] / 2)).cast("int") for c in XYZ} | {f"s{c}": (F.col(f"s{c}") + short[c]).cast("int") for c in XYZ}
    return voxels.withColumns(moved)


def reoriented(voxels: DataFrame, affine: list[list[float]], shape: tuple[int, int, int]) -> DataFrame:
    """voxels with axes in the order and direction of the world's: each grid axis goes to the world axis it runs along most, and is turned where it runs against it."""
    axis = [max(range(3), key=lambda r: abs(affine[r][c])) for c in range(3)]  # of each grid axis
    if sorted(axis) != [0, 1, 2]:
        raise ValueError("two axes of the grid run along one of the world")
    turned = [(F.col(c) if affine[axis[i]][i] > 0 else shape[i] - 1 - F.col(c)) for i, c in enumerate(XYZ)]
    return voxels.withColumns({XYZ[axis[i]]: turned[i] for i in range(3)})
