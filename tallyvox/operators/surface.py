"""Surface shells and distances between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distance as dt

XYZ = ["x", "y", "z"]
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def shell_lines(lines: DataFrame, by: list[str], masks: list[str]) -> DataFrame:
    """`distance.lines()` with only those bits of each mask whose voxel has fewer than six face neighbours in the mask; outside the grid is background. Each line is sent to the six around it and itself, and their bits are cut there: one shuffle, no join."""
    moves = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    seen = [F.struct(F.lit(k).alias("_k"), (F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (F.col("zb") + b).alias("zb")) for k, (i, j, b) in enumerate(moves)]
    sent = lines.select(*by, F.explode(F.array(*seen)).alias("_v"), *masks).select(*by, "_v.*", *masks)
    own = {(m, k): F.coalesce(F.bit_or(F.when(F.col("_k") == k, F.col(m))), F.lit(0).cast("long")).alias(f"{m}_{k}") for m in masks for k in range(7)}
    met = sent.groupBy(*by, "x", "y", "zb").agg(*own.values())
    inner = lambda m: [F.col(f"{m}_{k}") for k in (1, 2, 3, 4)] + [F.expr(f"shiftleft({m}_0, 1) | shiftrightunsigned({m}_5, 63)"), F.expr(f"shiftrightunsigned({m}_0, 1) | shiftleft({m}_6, 63)")]
    out = met
    for m in masks:
        around = F.lit(-1).cast("long")
        for c in inner(m):
            around = around.bitwiseAND(c)
        out = out.withColumn(m, F.col(f"{m}_0").bitwiseAND(F.bitwise_not(around)))
    return out.where(" or ".join(f"`{m}` <> 0" for m in masks)).select(*by, "x", "y", "zb", *masks)


def shell(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Foreground voxels with fewer than six foreground face neighbours; outside the grid is background."""
    found = shell_lines(dt.lines(voxels, by, {"own": F.lit(True)}), by, ["own"])
    return found.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("shiftrightunsigned(own, _i) & 1 = 1").select(*by, "x", "y", (F.col("zb") * 64 + F.col("_i")).alias("z"))


def surface_distances(voxels: DataFrame, by: list[str], spacing: tuple[float, float, float], tolerance: float = 2.0, gt: str = "a", pred: str = "b") -> DataFrame:
    """(by, hd95, asd, nsd): of both raters' shells. Groups that lack a side have no row; join back to find them null."""
    masks = {"gt": F.col("rater") == gt, "pred": F.col("rater") == pred}
    shells = shell_lines(dt.lines(voxels.where(F.col("rater").isin(gt, pred)), by, masks), by, list(masks))
    d = dt.nearest(shells, by, spacing, [("gt", "pred"), ("pred", "gt")])
    per = d.groupBy(*by, "side").agg(F.percentile("d", F.lit(0.95)).alias("h"), F.avg("d").alias("m"), F.avg((F.col("d") <= tolerance).cast("double")).alias("n"))
    return per.groupBy(*by).agg(F.max("h").alias("hd95"), (F.sum("m") / 2).alias("asd"), (F.sum("n") / 2).alias("nsd"), F.count("*").alias("sides")).where("sides = 2").drop("sides")


def hd95_of_points(voxels: DataFrame, by: list[str], spacing: tuple[float, float, float], every: int = 10, gt: str = "a", pred: str = "b") -> DataFrame:
    """The basic audit's variant: over all mask points, and of the source only each tenth in grid order."""
    from .curate import ranked

    numbered = ranked(voxels.where(F.col("rater").isin(gt, pred)), [F.col(c) for c in XYZ], "rn", [*by, "rater"])
    mine, asked = {"gt": F.col("rater") == gt, "pred": F.col("rater") == pred}, (F.col("rn") - 1) % every == 0
    rows = dt.lines(numbered, by, mine | {f"{k}_asked": on & asked for k, on in mine.items()})
    d = dt.nearest(rows, by, spacing, [("gt_asked", "pred"), ("pred_asked", "gt")])
    return d.groupBy(*by, "side").agg(F.percentile("d", F.lit(0.95)).alias("h")).groupBy(*by).agg(F.max("h").alias("hd95"))


def distance(p: list[Column], q: list[Column], spacing: tuple[float, float, float]) -> Column:
    return F.sqrt(sum(((a - b) * s) * ((a - b) * s) for a, b, s in zip(p, q, spacing, strict=True)))
