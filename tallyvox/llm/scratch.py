"""Tables written between the passes of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyvox-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB from here on in this session (64 by default), so that long texts stay small in executors' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """df after a write to the shared folder: its lineage ends there, and a lost executor costs no recomputation. by: a column of few values, each of which gets a folder."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tallyvox/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
