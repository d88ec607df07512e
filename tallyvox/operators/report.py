"""Reports over audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """(column, n, percent): nulls aren't listed, but count in the percentage's denominator."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row a value
    return counts.select(column, "n", F.round(100 * F.col("n") / total, digits).alias("percent")).where(F.col(column).isNotNull())


def means(df: DataFrame, by: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """Means that skip missing values."""
    return df.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def numeric_means(df: DataFrame, digits: int = 4) -> DataFrame:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.agg(*[F.round(F.avg(c), digits).alias(c) for c, kind in df.dtypes if kind in kinds])


def mean_and_std(df: DataFrame, by: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """Mean and sample standard deviation of each column."""
    return df.groupBy(*by).agg(*[x for c in columns for x in (F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_samp(c), digits).alias(f"{c}_std"))])


def tallies(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def best_rows(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """Each group's row with the largest score, the first by `order` of equals. An aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("_order"), F.struct(*rest).alias("row"))).alias("m"))
    return best.select(*by, "m.row.*")


def improved(df: DataFrame, by: list[str], score: str, order: str, start: float) -> DataFrame:
    """Rows whose score is above every earlier one's and above `start`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bar = F.greatest(F.lit(start), F.coalesce(F.max(score).over(before), F.lit(start)))
    return df.withColumn("_bar", bar).where(F.col(score) > F.col("_bar")).drop("_bar")


def wide(df: DataFrame, by: list[str], name: Column, value: str, names: list[str]) -> DataFrame:
    """One column for each of the listed names."""
    return df.withColumn("_name", name).groupBy(*by).pivot("_name", names).agg(F.first(value))


def lines(counts: DataFrame, column: str) -> DataFrame:
    """value_counts() as lines of text: name, count, percentage."""
    return counts.select(F.format_string("%-24s %6d (%6.2f%%)", F.col(column), "n", "percent").alias("line"))
