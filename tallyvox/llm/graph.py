"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links lead to.

    Large-star and small-star in turn: every node's neighbours are tied to the least of them, until the edges are stars, which
    is told exactly: each node has one edge to a lesser one, and no such lesser node has one itself. A round is two
    aggregations and joins on a node; a node with very many neighbours is pre-aggregated, and its join can be split.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
