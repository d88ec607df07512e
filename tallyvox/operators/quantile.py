"""Exact quantiles of groups by counting passes.

A quantile lies between two neighbours in a group's order. Each wanted rank begins with the interval from the group's least to its
greatest value. A pass counts the values of an interval in bins of equal width, with the least and the greatest value of each bin;
the bin that holds the rank is the next interval, and a bin of one value ends the search. So tasks hold counts of bins and never a
group's values, however many different ones it has. A pass narrows intervals by the number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BINS = 256
#: Groups whose intervals are sent to all tasks; with more, values and intervals are joined by group.
SENT_GROUPS = 1 << 16


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], *, bins: int = BINS, sent: int = SENT_GROUPS) -> DataFrame:
    """(by, quantiles): for each group an array with the quantile of each of probs, linear between the two values around (n - 1) * p. Null and NaN values don't count; groups without others have no row."""
    if bins < 2:
        raise ValueError("a pass needs two bins at least")
    values = written(rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    ends = written(values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    wanted = written(ends.select(*by, F.explode(ranks).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below")))
    few = ends.count() <= sent
    found = [wanted.where("_lo = _hi").select(*by, "_k", F.col("_lo").alias("_value"))]
    left = wanted.where("_lo < _hi")
    while not left.isEmpty():
        narrowed = written(_pass(values, left, by, bins, few))
        found.append(narrowed.where("_lo = _hi").select(*by, "_k", F.col("_lo").alias("_value")))
        left = narrowed.where("_lo < _hi")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ordered = every.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_value"))).alias("_of"))  # two ranks a quantile
    return ordered.join(ends.select(*by, "_n"), by).select(*by, F.array(*[_between(F.col("_of"), x) for x in at]).alias("quantiles"))


def _between(of: Column, at: Column) -> Column:
    low = F.element_at(of, F.floor(at).cast("long"))
    return low + (F.element_at(of, F.ceil(at).cast("long")) - low) * (at - F.floor(at))


def _pass(values: DataFrame, left: DataFrame, by: list[str], bins: int, few: bool) -> DataFrame:
    """(by, _k, _lo, _hi, _below) of the bins that the ranks of `left` are in. Ranks in one interval share its counts."""
    spans = left.groupBy(*by).agg(F.collect_set(F.struct("_lo", "_hi", "_below")).alias("_spans"))  # two a quantile at most
    met = values.join(F.broadcast(spans) if few else spans, by)
    met = met.select(*by, "_v", F.explode(F.filter("_spans", lambda s: F.col("_v").between(s["_lo"], s["_hi"]))).alias("_s"))
    half = lambda c: F.col(c) / 2  # noqa: E731  so that a width beyond the largest double doesn't overflow
    place = F.least((((half("_v") - half("_s._lo")) / (half("_s._hi") - half("_s._lo"))) * bins).cast("int"), F.lit(bins - 1))
    place = F.when(F.col("_v") >= F.col("_s._hi"), bins - 1).when(F.col("_v") <= F.col("_s._lo"), 0).otherwise(F.coalesce(place, F.lit(0)))
    counts = met.groupBy(*by, "_s", place.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = Window.partitionBy(*by, "_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    counts = counts.withColumn("_from", F.col("_s._below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return (
        left.select(*by, "_k", F.struct("_lo", "_hi", "_below").alias("_s")).join(counts, [*by, "_s"]).where("_k >= _from and _k < _from + _c")
        .select(*by, "_k", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_from").alias("_below"))
    )
