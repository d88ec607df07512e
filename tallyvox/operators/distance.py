"""Exact Euclidean distances on grids: lower envelopes of parabolas along x, then y, then z.

Points travel as lines: a row holds 64 places along z as the bits of a long (`lines()`), so a scan is a few rows a column of the
grid. A scan whose box is small is one row of lines, and a task takes many of them through the three passes at once. A larger one is
cut: the passes along x and y are done for one layer of z in a task, the pass along z for a slab of x, so a task holds a layer or a
slab of the box and never a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

XYZ = ["x", "y", "z"]
#: Cells of a box that is one task's; cells taken through the passes at once; columns of x in a slab of a larger one; places of masks unpacked at once.
CELLS, TOGETHER, SLAB, POINTS = 1 << 22, 1 << 17, 16, 1 << 18


def lines(voxels: DataFrame, by: list[str], masks: dict[str, Column]) -> DataFrame:
    """(by, x, y, zb, a long for each of masks): bit i is set where the mask holds at z = 64 zb + i. One shuffle, pre-aggregated."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("z", F.lit(64)).cast("int"))
    rows = voxels.withColumn("zb", F.floor(F.col("z") / 64).cast("int"))
    return rows.groupBy(*by, "x", "y", "zb").agg(*[F.coalesce(F.bit_or(F.when(on, bit)), F.lit(0).cast("long")).alias(name) for name, on in masks.items()])


def envelope(f: np.ndarray, step: float) -> np.ndarray:
    """Along the last axis of f (lines, n): at each place i the least of f[j] + (step * (i - j))**2 over j. Infinite where all of a line is.

    The parabolas that are least somewhere are kept on a stack for each line, with the places where each takes over; all lines
    move on together.
    """
    n_lines, n = f.shape
    if n == 1:
        return f
    parabola, begins, top = np.zeros((n_lines, n), np.int32), np.full((n_lines, n + 1), np.inf), np.full(n_lines, -1)
    for q in range(n):
        rows = np.flatnonzero(np.isfinite(f[:, q]))
        left, cut = np.arange(len(rows)), np.full(len(rows), -np.inf)
        while len(left):
            r = rows[left]
            has = top[r] >= 0
            cut[left[~has]] = -np.inf
            left, r = left[has], r[has]
            v = parabola[r, top[r]]
            s = (f[r, q] - f[r, v]) / (2 * step * step * (q - v)) + (q + v) / 2
            cut[left] = s
            below = s <= begins[r, top[r]]
            top[r[below]] -= 1
            left = left[below]
        top[rows] += 1
        parabola[rows, top[rows]], begins[rows, top[rows]] = q, cut
        begins[rows, top[rows] + 1] = np.inf
    out, at, every = np.full(f.shape, np.inf), np.zeros(n_lines, np.int64), np.flatnonzero(top >= 0)
    for q in range(n):
        left = every
        while len(left):
            left = left[begins[left, at[left] + 1] < q]
            at[left] += 1
        v = parabola[every, at[every]]
        out[every, q] = f[every, v] + (step * (q - v)) ** 2
    return out


def sweep(f: np.ndarray, axis: int, step: float) -> np.ndarray:
    """envelope() along an axis of f, which is 0 at hits and infinite elsewhere: parabolas of one height take over half-way, so the nearest hit on either side is the least."""
    f = np.moveaxis(f, axis, 0)
    for i in range(1, len(f)):
        np.minimum(f[i], f[i - 1] + step, out=f[i])
    for i in range(len(f) - 2, -1, -1):
        np.minimum(f[i], f[i + 1] + step, out=f[i])
    return np.moveaxis(f * f, 0, axis)


def passes(f: np.ndarray, spacing: tuple[float, ...], axes: tuple[int, ...]) -> np.ndarray:
    """f after a pass along each of these axes."""
    for axis, step in zip(axes, spacing, strict=True):
        turned = np.moveaxis(f, axis, -1)
        f = np.moveaxis(envelope(np.ascontiguousarray(turned).reshape(-1, turned.shape[-1]), step).reshape(turned.shape), -1, axis)
    return f


def places(x: np.ndarray, y: np.ndarray, b: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, xyz) of the set bits of lines."""
    on = np.unpackbits(np.ascontiguousarray(bits.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    line, z = np.nonzero(on)
    return line, np.stack([x[line], y[line], b[line].astype(np.int64) * 64 + z], 1).astype(np.int64)


def boxed(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first corner and the shape of the box of each of n scans, over several (scan, xyz)."""
    low, high = np.full((n, 3), np.iinfo(np.int64).max), np.full((n, 3), np.iinfo(np.int64).min)
    for scan, xyz in found:
        np.minimum.at(low, scan, xyz)
        np.maximum.at(high, scan, xyz)
    some = (high >= low).all(axis=1)
    return np.where(some[:, None], low, 0), np.where(some[:, None], high - low + 1, 0)


def squares(hit: tuple[np.ndarray, np.ndarray], ask: tuple[np.ndarray, np.ndarray], n: int, spacing: tuple[float, float, float]) -> np.ndarray:
    """The squared distance of each asked place to the nearest hit place of its scan; hit, ask: (scan, xyz) of n scans. Infinite without any."""
    low, shape = boxed([hit, ask], n)
    out = np.full(len(ask[0]), np.inf)
    order = np.lexsort(tuple(shape.T))  # scans of like shapes go through the passes together
    i = 0
    while i < n:
        j, size = i, np.zeros(3, np.int64)
        while j < n and (j - i + 1) * int(np.maximum(size, shape[order[j]]).prod()) <= max(TOGETHER, int(shape[order[i]].prod())):
            size, j = np.maximum(size, shape[order[j]]), j + 1
        slot = np.full(n, -1)
        slot[order[i:j]] = np.arange(j - i)
        mine, asked = slot[hit[0]] >= 0, slot[ask[0]] >= 0
        if size.all() and asked.any():
            f = np.full((j - i, *size), np.inf)
            f[(slot[hit[0][mine]], *(hit[1][mine] - low[hit[0][mine]]).T)] = 0
            x, y, z = (ask[1][asked] - low[ask[0][asked]]).T
            f = sweep(f, 1, spacing[0]).reshape(-1, *size[1:])
            layer, of = np.unique(slot[ask[0][asked]] * size[0] + x, return_inverse=True)  # only these go on along y
            f = passes(f[layer], spacing[1:2], (1,)).reshape(-1, size[2])
            column, of = np.unique(of * size[1] + y, return_inverse=True)  # and these along z
            out[asked] = envelope(f[column], spacing[2])[of, z]
        i = j
    return out


def nearest(rows: DataFrame, by: list[str], spacing: tuple[float, float, float], sides: list[tuple[str, str]], cells: int | None = None) -> DataFrame:
    """(by, side, x, y, z, d): for each (ask, hit) of sides, the distance of each place of mask `ask` to the nearest of mask `hit` in the unit of `spacing`. rows: lines() with these masks. Groups without hits have no rows.

    cells: boxes beyond so many (CELLS) are cut. Which are is known from two numbers an axis and group, not from their points.
    """
    masks = sorted({m for side in sides for m in side})
    rows = written(rows.select(*by, *[F.col(c).cast("int").alias(c) for c in ("x", "y", "zb")], *masks))
    size = F.lit(1).cast("double")
    for c, width in (("x", 1), ("y", 1), ("zb", 64)):
        size = size * (F.max(c) - F.min(c) + 1) * width
    group = F.collect_list(F.struct("x", "y", "zb", *masks))
    large = written(rows.groupBy(*by).agg(size.alias("cells")).where(F.col("cells") > (cells or CELLS)).drop("cells"))
    if large.isEmpty():
        return _whole(rows.groupBy(*by).agg(group.alias("lines")), by, spacing, sides)
    small = rows.join(large, by, "left_anti").groupBy(*by).agg(group.alias("lines"))  # of a box of few cells
    return _whole(small, by, spacing, sides).unionByName(_cut(rows.join(large, by, "left_semi"), by, spacing, sides))


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*by).dtypes)


def few(rows: pa.RecordBatch, points: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows with lists of lines, so many that their masks have up to `points` (POINTS) places together; one at least."""
    listed = rows.column("lines")
    at = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
    masks = [listed.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3, listed.type.value_type.num_fields)]
    size = np.concatenate([[0], np.cumsum(sum(np.bitwise_count(m.view(np.uint64)).astype(np.int64) for m in masks))])[at]
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(size, size[i] + (points or POINTS), "right")) - 1)
        yield rows.slice(i, j - i)
        i = j


def _whole(scans: DataFrame, by: list[str], spacing: tuple[float, float, float], sides: list[tuple[str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for batch in batches for some in few(batch)):
            listed = rows.column("lines")
            line = {f.name: listed.flatten().field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(listed.type.value_type)}
            scan = np.repeat(np.arange(rows.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            for side, (ask, hit) in enumerate(sides):
                a, h = (places(line["x"], line["y"], line["zb"], line[m]) for m in (ask, hit))
                d = squares((scan[h[0]], h[1]), (scan[a[0]], a[1]), rows.num_rows, spacing)
                ok = np.flatnonzero(np.isfinite(d))
                key = [rows.column(c).take(pa.array(scan[a[0]][ok])) for c in by]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.full(len(ok), side, np.int32)), *(pa.array(a[1][ok, k].astype(np.int32)) for k in range(3)), pa.array(np.sqrt(d[ok]))], names=[*by, "side", *XYZ, "d"])

    return scans.mapInArrow(run, f"{_kinds(scans, by)}, side int, x int, y int, z int, d double")


def _cut(rows: DataFrame, by: list[str], spacing: tuple[float, float, float], sides: list[tuple[str, str]]) -> DataFrame:
    """Layers of z, then slabs of x. A layer sends on its squares over the box, as bytes for each slab."""
    each = F.array(*[F.struct(F.lit(k).alias("side"), F.col(ask).alias("ask"), F.col(hit).alias("hit")) for k, (ask, hit) in enumerate(sides)])
    flat = rows.select(*by, "x", "y", "zb", F.explode(each).alias("_s")).select(*by, "x", "y", "zb", "_s.*")
    edge = flat.groupBy(*by, "side").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    voxels = flat.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumns({c: F.expr(f"shiftrightunsigned({c}, _i) & 1 = 1") for c in ("ask", "hit")}).where("ask or hit")
    voxels = written(voxels.select(*by, "side", "x", "y", (F.col("zb") * 64 + F.col("_i")).alias("z"), "ask", "hit"))
    kinds = _kinds(rows, by)

    def layer(found: pa.Table) -> pa.Table:
        x, y, x0, x1, y0, y1 = (found.column(c).to_numpy() for c in ("x", "y", "x0", "x1", "y0", "y1"))
        f = np.full((x1[0] - x0[0] + 1, y1[0] - y0[0] + 1), np.inf)
        f[x - x0, y - y0] = 0
        f = passes(sweep(f, 0, spacing[0]), spacing[1:2], (1,))
        first = np.arange(0, len(f), SLAB)
        key = found.select([*by, "side", "z", "x0", "y0"]).take(pa.array(np.zeros(len(first), np.int64)))
        more = {"wide": np.full(len(first), f.shape[1], np.int32), "slab": (first // SLAB).astype(np.int32), "f": pa.array([f[i : i + SLAB].tobytes() for i in first], pa.binary())}
        return pa.table({c: key.column(c) for c in key.column_names} | more)

    def slab(_: tuple, asked: pa.Table, found: pa.Table) -> pa.Table:
        names = [*by, "side", *XYZ]
        if not asked.num_rows or not found.num_rows:
            return asked.select(names).slice(0, 0).append_column("d", pa.array([], pa.float64()))
        x0, y0, wide, k = (found.column(c)[0].as_py() for c in ("x0", "y0", "wide", "slab"))
        at, z = found.column("z").to_numpy(), asked.column("z").to_numpy()
        low, high = min(at.min(), z.min()), max(at.max(), z.max())
        place = (asked.column("x").to_numpy() - x0 - SLAB * k).astype(np.int64) * wide + asked.column("y").to_numpy() - y0
        column, of = np.unique(place, return_inverse=True)  # the columns along z that are asked for
        f = np.full((len(column), high - low + 1), np.inf)
        for z1, raw in zip(at, found.column("f"), strict=True):
            f[:, z1 - low] = np.frombuffer(raw.as_buffer(), np.float64)[column]
        return asked.select(names).append_column("d", pa.array(np.sqrt(envelope(f, spacing[2])[of, z - low])))

    key = [*by, "side", "slab"]
    layers = voxels.where("hit").join(edge, [*by, "side"]).groupBy(*by, "side", "z").applyInArrow(layer, f"{kinds}, side int, z int, x0 int, y0 int, wide int, slab int, f binary")
    asked = voxels.where("ask").join(edge, [*by, "side"]).select(*by, "side", *XYZ, F.floor((F.col("x") - F.col("x0")) / SLAB).cast("int").alias("slab"))
    return asked.groupBy(*key).cogroup(layers.groupBy(*key)).applyInArrow(slab, f"{kinds}, side int, x int, y int, z int, d double")
