"""Sliding windows: cut from voxels with a halo, put through a function one by one, and blended back by overlap-add.

A voxel is sent to the windows it lies in, so a window is gathered in one task, and a task holds windows, never a scan. What the
windows give for a voxel is added up with weights where the voxel lies; sums are taken in the tasks first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]
#: Places of windows in one Arrow batch; a larger window is alone.
TOGETHER = 1 << 18


def begins(length: Column, size: int, overlap: float) -> Column:
    """Where windows begin along an axis: in steps of size * (1 - overlap), the last one flush with the end."""
    step = max(1, int(size * (1 - overlap)))
    last = F.greatest(F.lit(0), length - size)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last + step - 1, F.lit(step)), lambda v: F.least(v, F.greatest(F.lit(0), length - size))))


def cut(voxels: DataFrame, scans: DataFrame, by: list[str], *, size: int = 96, overlap: float = 0.25, halo: int = 0, value: str = "value") -> DataFrame:
    """(by, shape, x0, y0, z0, voxels): each window of scans(by, shape) with its voxels and those up to `halo` places around it, as an array of (x, y, z, v). Windows without any aren't rows."""
    rows = voxels.select(*by, *XYZ, F.col(value).cast("double").alias("v")).join(scans.select(*by, "shape").hint("merge"), by)
    for k, c in enumerate(XYZ):
        at = F.col(c)
        rows = rows.withColumn(f"{c}0", F.explode(F.filter(begins(F.col("shape")[k], size, overlap), lambda b: (at >= b - halo) & (at < b + size + halo))))  # noqa: B023
    return rows.groupBy(*by, "shape", "x0", "y0", "z0").agg(F.collect_list(F.struct(*XYZ, "v")).alias("voxels"))  # of one window


def applied(windows: DataFrame, f: Callable[[np.ndarray], np.ndarray | float], by: list[str], *, size: int = 96, halo: int = 0) -> DataFrame:
    """(by, x0, y0, z0, x, y, z, v): f of each window as an array of size + 2 * halo places an axis (0 where nothing is stored or the scan has ended), for each place of the window that is in the scan. f returns one number, or an array of the window without its halo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            begins = np.stack([rows.column(c).to_numpy() for c in ("x0", "y0", "z0")], 1)
            shapes = np.minimum(np.array(rows.column("shape").to_pylist()).reshape(-1, 3) - begins, size)
            listed = rows.column("voxels")
            upto = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
            x, y, z, v = (listed.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            places, values = np.stack([x, y, z], 1), np.nan_to_num(v)
            held, first = [], 0
            for i in range(rows.num_rows):
                here = slice(upto[i], upto[i + 1])
                block = np.zeros((size + 2 * halo,) * 3)
                block[tuple((places[here] - begins[i] + halo).T)] = values[here]
                held.append(np.broadcast_to(np.asarray(f(block), float), (size,) * 3)[tuple(slice(n) for n in shapes[i])])
                if (i + 1 - first) * size**3 >= TOGETHER or i + 1 == rows.num_rows:  # small windows share a batch
                    yield joined(rows.slice(first, i + 1 - first), begins[first : i + 1], held)
                    held, first = [], i + 1

    def joined(rows: pa.RecordBatch, begins: np.ndarray, outs: list[np.ndarray]) -> pa.RecordBatch:
        grids = {o.shape: np.indices(o.shape).reshape(3, -1).T for o in outs}
        of = np.repeat(np.arange(len(outs)), [o.size for o in outs])
        at = np.concatenate([grids[o.shape] for o in outs]) + begins[of]
        key = [rows.column(c).take(pa.array(of)) for c in [*by, "x0", "y0", "z0"]]
        return pa.RecordBatch.from_arrays([*key, *(pa.array(at[:, k].astype(np.int32)) for k in range(3)), pa.array(np.concatenate([o.ravel() for o in outs]))], names=[*by, "x0", "y0", "z0", *XYZ, "v"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in windows.select(*by, "x0", "y0", "z0").dtypes)
    return windows.mapInArrow(run, f"{kinds}, x int, y int, z int, v double")


def weights(size: int, kind: str = "constant", sigma: float = 0.125) -> list[float]:
    """Of the places of a window along an axis: all alike, or a bell around the middle of `sigma` times the size."""
    if kind == "constant":
        return [1.0] * size
    if kind != "gaussian":
        raise ValueError(f"no such weights: {kind}")
    return [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * (sigma * size) ** 2)) for i in range(size)]


def blended(outputs: DataFrame, by: list[str], *, size: int = 96, kind: str = "constant", sigma: float = 0.125) -> DataFrame:
    """(by, x, y, z, v): the weighted mean of what the windows give for each voxel."""
    return blends(outputs, by, {"v": weights(size, kind, sigma)})


def blends(outputs: DataFrame, by: list[str], ways: dict[str, list[float]]) -> DataFrame:
    """(by, x, y, z, ways): the mean of what the windows give for each voxel by several weights() in one pass, so that the windows are made once."""
    rows = outputs
    for name, ws in ways.items():
        w, weight = F.array(*[F.lit(x) for x in ws]), F.lit(1.0)
        for c in XYZ:
            weight = weight * F.get(w, F.col(c) - F.col(f"{c}0"))
        rows = rows.withColumn(f"_w_{name}", weight)
    return rows.groupBy(*by, *XYZ).agg(*[(F.sum(F.col(f"_w_{name}") * F.col("v")) / F.sum(f"_w_{name}")).alias(name) for name in ways])
