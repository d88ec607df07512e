"""Consensus of several raters. Votes of an element are first gathered in one array, in the raters' order; pairs of raters are then unrolled inside the row, so there is no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import ORGANS, entropy, one_hot, top_class


def gathered(votes: DataFrame, keys: list[str], raters: list[int], rater: str = "rater", label: str = "label") -> DataFrame:
    """(keys, labels): an array with each rater's label of the element, 0 for none. The raters are a parameter, so arrays are short."""
    return votes.where(F.col(rater).isin(*raters)).groupBy(*keys).agg(F.array(*[F.coalesce(F.max(F.when(F.col(rater) == r, F.col(label))), F.lit(0)) for r in raters]).alias("labels"))


def pair_dice(wide: DataFrame, by: list[str], raters: int, organs: list[int] | None = None) -> DataFrame:
    """(by, i, j, organ, dice) of rater pairs i < j; organ is null for foreground as a whole, or each of `organs`. Empty pairs have 1."""
    is_ = lambda i, k: (F.col("labels")[i] > 0) if k is None else (F.col("labels")[i] == k)
    cells = [(i, j, k) for i in range(raters) for j in range(i + 1, raters) for k in (organs or [None])]
    counts = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).cast("int").alias("organ"), F.count_if(is_(i, k) & is_(j, k)).alias("both"), (F.count_if(is_(i, k)) + F.count_if(is_(j, k))).alias("sum")) for i, j, k in cells]
    rows = wide.groupBy(*by).agg(F.array(*counts).alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")
    return rows.select(*by, "i", "j", "organ", F.when(F.col("sum") > 0, 2 * F.col("both") / F.col("sum")).otherwise(1.0).alias("dice"))


def diversity_weights(pairs: DataFrame, by: list[str], raters: int) -> DataFrame:
    """(by, weights): redundancy is the mean Dice with the others; what a rater says that others don't is its weight, 0.05 at least, and weights sum to 1."""
    mean = [F.sum(F.when((F.col("i") == r) | (F.col("j") == r), F.col("dice")).otherwise(0.0)) / (raters - 1 + 1e-7) for r in range(raters)]
    raw = F.array(*[F.least(F.greatest(1 - x, F.lit(0.05)), F.lit(1.0)) for x in mean]) if raters > 1 else F.array(F.lit(1.0))
    return pairs.groupBy(*by).agg(raw.alias("raw")).select(*by, F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)).alias("weights"))


def consensus(weighted: DataFrame, raters: int, classes: int = 5, probabilities: bool = False) -> DataFrame:
    """weighted (labels or per-rater probability arrays in `labels`, and weights) with p (weighted class probabilities), label (the first of the most probable) and h (entropy). Ties are told at 9 digits, so that the order of sums can't turn them."""
    vote: list[Column] = []
    for c in range(classes):
        part = [F.col("weights")[r] * (F.col("labels")[r][c] if probabilities else (F.col("labels")[r] == c).cast("double")) for r in range(raters)]
        vote.append(sum(part[1:], part[0]))
    out = weighted.withColumn("p", F.array(*vote))
    return out.withColumn("label", top_class(F.transform("p", lambda x: F.round(x, 9)))).withColumn("h", entropy(F.col("p")))


def background_entropy(classes: int = 5, low: float = 1e-7) -> float:
    """The entropy of an element that all raters call background, for grids that don't store it."""
    import math

    return -((1 - low) * math.log2(1 - low)) - (classes - 1) * low * math.log2(low)


def ensemble(votes: DataFrame, raters: list[int], subject: str = "subject", element: str = "element") -> tuple[DataFrame, DataFrame]:
    """(elements, weights): labels, weights, p, label and h of each element; each subject's weights. A subject's weights are joined back by its key; the side is one row a subject."""
    wide = gathered(votes, [subject, element], raters)
    weights = diversity_weights(pair_dice(wide, [subject], len(raters)), [subject], len(raters))
    return consensus(wide.join(weights, subject), len(raters)), weights


def audit(elements: DataFrame, betti: DataFrame, raters: int, subject: str = "subject") -> DataFrame:
    """One row a subject: means over organs of the means over raters (not pooled), largest topology term, entropy. betti: (subject, organ, differences), the raters' absolute differences from the consensus in components."""
    label, organs = F.col("label"), list(ORGANS)
    cells = []
    for r in range(raters):
        for k in organs:
            a, b = F.col("labels")[r] == k, label == k
            cells.append(F.struct(F.lit(k).alias("organ"), F.count_if(a & b).alias("both"), (F.count_if(a) + F.count_if(b)).alias("sum"), F.count_if(a | b).alias("union")))
    counts = elements.groupBy(subject).agg(F.array(*cells).alias("c"), F.avg("h").alias("mean_h"), F.max("h").alias("max_h"))
    per = counts.select(subject, "mean_h", "max_h", F.explode("c").alias("c")).select(subject, "mean_h", "max_h", "c.*")
    one = lambda num, den: F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(1.0)
    per = per.withColumns({"dice": F.when(F.col("sum") > 0, 2 * F.col("both") / F.col("sum")).otherwise(1.0), "iou": one("both", "union")})
    organ = per.groupBy(subject, "organ").agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.first("mean_h").alias("mean_h"), F.first("max_h").alias("max_h"))
    inter = pair_dice(elements, [subject], raters, organs).groupBy(subject, "organ").agg(F.avg("dice").alias("inter"))
    both = organ.join(inter, [subject, "organ"]).groupBy(subject).agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.avg("inter").alias("inter"), F.first("mean_h").alias("mean_h"), F.first("max_h").alias("max_h"))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    betti = betti.groupBy(subject).agg(F.max(F.array_max("differences")).alias("betti"))
    return both.join(betti, subject, "left").select(subject, r4("dice", "mean_consensus_dice"), r4("iou", "mean_consensus_iou"), r4("inter", "mean_inter_model_dice"), F.coalesce("betti", F.lit(0)).alias("max_betti_diff"), r4("mean_h", "mean_uncertainty"), r4("max_h", "max_uncertainty"))


def dropout_variance(samples: DataFrame, by: list[str], element: list[str]) -> DataFrame:
    """(by, variance): population variance over samples of (sample, cls, p), averaged over classes, then over elements."""
    per = samples.groupBy(*by, *element, "cls").agg(F.var_pop("p").alias("v"))
    return per.groupBy(*by, *element).agg(F.avg("v").alias("v")).groupBy(*by).agg(F.avg("v").alias("variance"))


def expanded(votes: DataFrame, classes: int = 5) -> DataFrame:
    return votes.withColumn("p", one_hot(F.col("label"), classes))


def shares(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """value's share of its group's total."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))
