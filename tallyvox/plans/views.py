"""Rater tables from the driver's star schema, in Spark and as SQL text that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import softmax
from .registry import table

RATERS, SIDE = [1, 2, 3], 8


def raters_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, element, l1, l2, l3): a label of 0 to 4 by event type, and two raters that differ from it on some events."""
    kind = F.col("event_type")
    g = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(0)
    base = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("element"), g.alias("l1"))
    s, e = F.col("subject"), F.col("element")
    return base.withColumns({"l2": F.when(e % (3 + s % 60) == 0, (F.col("l1") + 1) % 5).otherwise(F.col("l1")), "l3": F.when(e % (4 + s % 45) == 1, (F.col("l1") + 2) % 5).otherwise(F.col("l1"))})


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raters_wide() with x, y, z: a subject's elements, by the first rater's label and their number, fill a grid of 8 by 8 in rows and layers."""
    n = F.row_number().over(Window.partitionBy("subject").orderBy("l1", "element")) - 1  # of one scan
    return raters_wide(spark, sf_dir).withColumn("n", n).withColumns({"x": F.col("n") % SIDE, "y": F.floor(F.col("n") / SIDE).cast("int") % SIDE, "z": F.floor(F.col("n") / SIDE**2).cast("int")}).drop("n")


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, element, rater, label)."""
    return raters_wide(spark, sf_dir).unpivot(["subject", "element"], ["l1", "l2", "l3"], "rater", "label").withColumn("rater", F.substring("rater", 2, 1).cast("int"))


def pairs(spark: SparkSession, sf_dir: str, first: int = 1, second: int = 2) -> DataFrame:
    return raters_wide(spark, sf_dir).select("subject", "element", F.col(f"l{first}").alias("gt"), F.col(f"l{second}").alias("pred"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element, p, truth): class probabilities from the first five components of a vector."""
    z = F.transform(F.slice("embedding", 1, 5), lambda x: 4 * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("element"), softmax(z).alias("p"), (F.col("label") % 5).alias("truth"))


GRID, SPACING = 14, (1.5, 1.5, 2.0)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in as many partitions as a shuffle has: a few small rows of a file become very many voxels, so they are dealt out first, by scan."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject): a scan for each part, dealt out."""
    return dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject")), "subject")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, rater, x, y, z): foreground voxels of two raters' boxes in a 14-cube, a scan for each part, dealt out by scan."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("subject"), (F.col("p_size") % 3).alias("s"), (F.col("p_partkey") % 3).alias("d"), (F.col("p_size") % 2).alias("t"))
    seq = lambda lo, hi: F.sequence(F.lit(lo) if isinstance(lo, int) else lo, F.lit(hi) if isinstance(hi, int) else hi)
    both = p.select("subject", F.explode(F.array(F.struct(F.lit("a").alias("rater"), (2 + F.col("s")).alias("x0"), (6 + F.col("s")).alias("x1"), F.lit(5).alias("z1")), F.struct(F.lit("b").alias("rater"), (2 + F.col("s") + F.col("d")).cast("int").alias("x0"), (6 + F.col("s")).alias("x1"), (5 + F.col("t")).alias("z1")))).alias("r")).select("subject", "r.*")
    body = both.select("subject", "rater", F.explode(seq(F.col("x0"), F.col("x1"))).alias("x"), "z1").select("subject", "rater", "x", F.explode(seq(2, 6)).alias("y"), "z1").select("subject", "rater", "x", "y", F.explode(seq(2, F.col("z1"))).alias("z"))
    far = p.where(F.col("subject") % 2 == 0).select("subject", F.lit("b").alias("rater"), F.lit(13).alias("x"), F.lit(13).alias("y"), F.lit(13).alias("z"))
    return body.unionByName(far)


WIDE_SQL = """raters AS (SELECT user_id AS subject, event_id AS element, g AS l1,
    CASE WHEN event_id % (3 + user_id % 60) = 0 THEN (g + 1) % 5 ELSE g END AS l2,
    CASE WHEN event_id % (4 + user_id % 45) = 1 THEN (g + 2) % 5 ELSE g END AS l3
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS g FROM events))"""
PLACED_SQL = """placed AS (SELECT subject, element, l1, l2, l3, n, n % 8 AS x, n // 8 % 8 AS y, n // 64 AS z FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY l1, element) - 1 AS n FROM raters))"""
PROBS_SQL = """z AS (SELECT vec_id AS element, label % 5 AS truth, list_transform(embedding[1:5], lambda x: 4 * CAST(x AS DOUBLE)) AS v FROM embeddings),
ez AS (SELECT element, truth, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM z),
probs AS (SELECT element, truth, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ez)"""
BOXES_SQL = """dims AS (SELECT p_partkey AS subject, p_size % 3 AS s, p_partkey % 3 AS d, p_size % 2 AS t FROM part),
spans AS (SELECT subject, 'a' AS rater, 2 + s AS x0, 6 + s AS x1, 5 AS z1 FROM dims UNION ALL SELECT subject, 'b', 2 + s + d, 6 + s, 5 + t FROM dims),
boxes AS (SELECT subject, rater, x.i AS x, y.i AS y, z.i AS z FROM spans, (SELECT range AS i FROM range(14)) x, (SELECT range AS i FROM range(14)) y, (SELECT range AS i FROM range(14)) z
    WHERE x.i BETWEEN x0 AND x1 AND y.i BETWEEN 2 AND 6 AND z.i BETWEEN 2 AND z1
  UNION ALL SELECT subject, 'b', 13, 13, 13 FROM dims WHERE subject % 2 = 0)"""
