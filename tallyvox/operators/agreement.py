"""Agreement of two labelings of the same elements, each one aggregate over a table of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.metrics import Empty
from ..functions.rules import ORGANS


def co_located(votes: DataFrame, first: int, second: int, keys: list[str], rater: str = "rater", label: str = "label") -> DataFrame:
    """(keys, gt, pred): both raters' labels of each element, 0 where one didn't label it. One shuffle, no join."""
    is_ = lambda r: F.max(F.when(F.col(rater) == r, F.col(label)))
    return votes.where(F.col(rater).isin(first, second)).groupBy(*keys).agg(F.coalesce(is_(first), F.lit(0)).alias("gt"), F.coalesce(is_(second), F.lit(0)).alias("pred"))


def confusion(pairs: DataFrame, by: list[str], classes: list[int] | None = None, total: Column | None = None) -> DataFrame:
    """(by, organ, tp, fp, fn, tn) for each class. total: elements of a group's grid, where background pairs aren't rows."""
    classes = list(ORGANS) if classes is None else classes
    gt, pred = F.col("gt"), F.col("pred")
    counts = [F.struct(F.lit(k).alias("organ"), F.count_if((gt == k) & (pred == k)).alias("tp"), F.count_if((gt != k) & (pred == k)).alias("fp"), F.count_if((gt == k) & (pred != k)).alias("fn")) for k in classes]
    size = F.count("*") if total is None else F.max(total)
    rows = pairs.groupBy(*by).agg(F.array(*counts).alias("c"), size.alias("size")).select(*by, "size", F.explode("c").alias("c")).select(*by, "size", "c.*")
    return rows.select(*by, "organ", "tp", "fp", "fn", (F.col("size") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def overlap(counts: DataFrame, empty: Empty = Empty.ONE) -> DataFrame:
    """counts with dice, iou, precision, sensitivity, specificity, voe and rvd."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"dice": m.dice(tp, fp, fn, empty), "iou": m.iou(tp, fp, fn, empty), "precision": m.precision(tp, fp, fn), "sensitivity": m.sensitivity(tp, fp, fn), "specificity": m.specificity(tn, fp), "voe": m.voe(tp, fp, fn), "rvd": m.rvd(tp, fp, fn)})


def contingency(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by, "gt", "pred").agg(F.count("*").cast("double").alias("n"))


def clustering(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, ari, voi): adjusted Rand index (1 where both agree wholly) and variation of information in bits. Cells of the contingency table are few, so what follows the first aggregate is small."""
    cells = contingency(pairs, by)
    rows, cols = cells.groupBy(*by, "gt").agg(F.sum("n").alias("_a")), cells.groupBy(*by, "pred").agg(F.sum("n").alias("_b"))
    both = cells.join(rows, [*by, "gt"]).join(cols, [*by, "pred"])
    n, a, b = F.col("n"), F.col("_a"), F.col("_b")
    sums = both.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum(n * n).alias("_nn"), F.sum(n * a).alias("_na"), F.sum(n * b).alias("_nb"), F.sum(n * (F.log2(n / a) + F.log2(n / b))).alias("_h"))
    total, s, a, b = F.col("_n"), F.col("_nn"), F.col("_na"), F.col("_nb")  # sum of n * a over cells is that of a * a over rows
    tp, fn, fp, tn = s - total, a - s, b - s, total * total - a - b + s
    den = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / F.nullif(den, F.lit(0.0)))
    return sums.select(*by, ari.alias("ari"), (-F.col("_h") / total).alias("voi"))


def sampled(pairs: DataFrame, position: Column, every: int = 50) -> DataFrame:
    """Every so many elements by their position in the grid."""
    return pairs.where(position % every == 0)


def calibration_error(p: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, ece) of (conf, pred, truth) rows: bins (lo, hi] of even width; a confidence of 0 is in none, but counts in the size."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    slot = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        slot = F.when((F.col("conf") > edges[i]) & (F.col("conf") <= edges[i + 1]), i).otherwise(slot)
    right = (F.col("pred") == F.col("truth")).cast("double")
    per = p.withColumn("slot", slot).groupBy(*by, "slot").agg(F.count("*").alias("k"), F.avg(right).alias("acc"), F.avg("conf").alias("mean"))
    part = F.when(F.col("slot").isNotNull(), F.abs(F.col("acc") - F.col("mean")) * F.col("k")).otherwise(0.0)
    return per.groupBy(*by).agg((F.sum(part) / F.sum("k")).alias("ece"))


def histogram(labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by, label, n, percent) of each group's elements."""
    counts = labels.groupBy(*by, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, label, "n", (100 * F.col("n") / F.col("total")).alias("percent"))
