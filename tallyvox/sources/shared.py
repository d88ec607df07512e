"""Folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='tallyvox-')).rstrip('/')}/tallyvox/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df after a write to the shared folder: read twice, it's the same rows twice."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
