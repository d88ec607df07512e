"""Forward values of segmentation losses as aggregates over (by, p, truth) rows; p holds class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import IGNORE


def _overlaps(rows: DataFrame, by: list[str], classes: int) -> list:
    return [x for c in range(1, classes) for x in (F.sum(F.when(F.col("truth") == c, F.col("p")[c]).otherwise(0.0)).alias(f"i{c}"), F.sum(F.col("p")[c]).alias(f"p{c}"), F.count_if(F.col("truth") == c).alias(f"g{c}"))]


def dice_ce(rows: DataFrame, by: list[str], classes: int = 5, ignore: int = IGNORE) -> DataFrame:
    """(by, loss): half cross-entropy (mean over valid rows), half 1 - 2i / (p + g + 1e-6), averaged over foreground classes."""
    valid = rows.where(F.col("truth") != ignore)
    ce = F.avg(-F.log(F.element_at("p", F.col("truth") + 1))).alias("ce")
    s = valid.groupBy(*by).agg(ce, *_overlaps(valid, by, classes))
    soft = [1 - 2 * F.col(f"i{c}") / (F.col(f"p{c}") + F.col(f"g{c}") + 1e-6) for c in range(1, classes)]
    return s.select(*by, (0.5 * F.col("ce") + 0.5 * sum(soft[1:], soft[0]) / (classes - 1)).alias("loss"))


def asymmetric(rows: DataFrame, by: list[str], alpha: float = 0.7, classes: int = 5, ignore: int = IGNORE) -> DataFrame:
    """(by, loss): cross-entropy with foreground weighted by alpha over the valid rows, and soft Dice (smoothed by 1e-5) over foreground classes that occur, 0 if none does. The other weight isn't used with several classes."""
    valid = rows.where(F.col("truth") != ignore)
    p = F.least(F.greatest(F.element_at("p", F.col("truth") + 1), F.lit(1e-7)), F.lit(1 - 1e-7))
    ce = (F.sum(-F.log(p) * F.when(F.col("truth") > 0, alpha).otherwise(1.0)) / F.greatest(F.count("*"), F.lit(1))).alias("ce")
    s = valid.groupBy(*by).agg(ce, *_overlaps(valid, by, classes))
    one = lambda c: F.when(F.col(f"g{c}") > 0, 1 - (2 * F.col(f"i{c}") + 1e-5) / (F.col(f"p{c}") + F.col(f"g{c}") + 1e-5)).otherwise(0.0)
    there = sum((F.when(F.col(f"g{c}") > 0, 1).otherwise(0) for c in range(2, classes)), F.when(F.col("g1") > 0, 1).otherwise(0))
    soft = sum((one(c) for c in range(2, classes)), one(1)) / F.greatest(there, F.lit(1))
    return s.select(*by, (0.5 * F.col("ce") + soft).alias("loss"))


def asymmetric_binary(rows: DataFrame, by: list[str], alpha: float = 0.7, beta: float = 0.3, ignore: int = IGNORE) -> DataFrame:
    """(by, loss) of (p, truth) rows with one probability: -(alpha * t * ln p + beta * (1 - t) * ln(1 - p)) over the valid rows."""
    valid = rows.where(F.col("truth") != ignore)
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    t = F.col("truth")
    return valid.groupBy(*by).agg((F.sum(-(alpha * t * F.log(p) + beta * (1 - t) * F.log(1 - p))) / F.greatest(F.count("*"), F.lit(1))).alias("loss"))


def gold_weighted(batches: DataFrame, by: list[str], weight: float = 10.0) -> DataFrame:
    """(by, loss): ten times the loss where any row of the batch is gold."""
    return batches.groupBy(*by).agg((F.avg("loss") * F.when(F.bool_or("gold"), weight).otherwise(1.0)).alias("loss"))
