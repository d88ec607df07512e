"""Tables of audits, manifests and lists: text, CSV and JSON, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = T.StructType([T.StructField(c, k) for c, k in (("subject_id", T.StringType()), ("status", T.StringType()), ("mean_consensus_dice", T.DoubleType()), ("mean_consensus_iou", T.DoubleType()), ("mean_inter_model_dice", T.DoubleType()), ("max_betti_diff", T.IntegerType()), ("mean_uncertainty", T.DoubleType()), ("max_uncertainty", T.DoubleType()), ("triage_category", T.StringType()), ("action", T.StringType()))])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ids stay strings: nothing is inferred, so no leading zero is lost."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_shards(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Several CSV files in one table, unreadable ones left out, with the file each row is from."""
    return spark.read.schema(schema).option("header", True).option("ignoreCorruptFiles", True).csv(paths).select("*", F.col("_metadata.file_path").alias("file"))


def merged_shards(rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """The first row of each key, by file, then by position in the table's order of columns."""
    from ..operators.curate import first_rows

    rest = [c for c in rows.columns if c not in (key, "file")]
    return first_rows(rows, [key], [F.col("file"), *[F.col(c) for c in rest]]).drop("file")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id): one a line, trimmed, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("subject_id")).where("subject_id <> ''")


def write_list(df: DataFrame, column: str, path: str) -> None:
    """Sorted ids, one a line, over as many part files as the sort has ranges."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_partition(df: DataFrame, path: str, part: str) -> None:
    """An incremental checkpoint: rows go to their own partition, which a repeated run replaces."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def split_manifest(splits: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row with the JSON of a split manifest: thresholds, and count and ids of each category."""
    entry = F.struct(F.col("n").alias("count"), F.split("subject_ids", ",").alias("subject_ids"))
    listed = splits.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", entry.alias("v"))))).alias("splits"))  # one entry a category
    return listed.select(F.to_json(F.struct(F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))]).alias("thresholds"), "splits")).alias("value"))


#: Batches of a checkpoint in one folder.
BATCHES = 1000


def put_batches(rows: DataFrame, path: str) -> None:
    """Write rows(batch) in the place of the batches they are of. Batches lie many to a folder, so that folders, which the driver moves one by one, grow a thousand times slower than batches; the others of a folder are written again with them."""
    from .shared import written
    from .versions import Store

    spark, folder = rows.sparkSession, F.floor(F.col("batch") / BATCHES).cast("int")
    new = written(rows)
    if Store(spark, path).names(""):
        touched = [r[0] for r in new.select(folder).distinct().collect()]  # a thousandth of the batches
        there = spark.read.parquet(path).where(F.col("folder").isin(touched)).drop("folder").join(new.select("batch").distinct(), "batch", "left_anti")
        new = written(new.unionByName(there))
    append_partition(new.withColumn("folder", folder).repartition("folder"), path, "folder")


def checkpoint(rows: DataFrame, path: str, key: str, every: int = 50, start: int = 0) -> None:
    """Write rows in batches of so many by their key, numbered from `start`; a repeated run replaces its batches."""
    from ..operators.curate import ranked

    put_batches(ranked(rows, [F.col(key)]).withColumn("batch", (F.lit(start) + F.floor((F.col("rn") - 1) / every)).cast("int")).drop("rn"), path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, every: int = 50) -> None:
    """Resume: rows whose key is there replace it in its batch, which is written anew; others go to new batches. rows has one row a key. A stop between the two writes is mended by a repeated run with the same rows; `versions.VersionedTable` is whole or not at all."""
    from .shared import written

    old = spark.read.parquet(path).drop("folder")
    last = old.agg(F.max("batch")).first()[0]
    placed = written(rows.join(old.select(key, "batch"), key, "left"))
    touched = placed.where("batch is not null").select("batch").distinct()
    kept = old.join(touched, "batch", "left_semi").join(rows.select(key), key, "left_anti")
    put_batches(kept.unionByName(placed.where("batch is not null")), path)
    checkpoint(placed.where("batch is null").drop("batch"), path, key, every, 0 if last is None else last + 1)
