"""Manifests of cohorts: ids as rows in files by category, and one small JSON that is written last and tells what there is."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Store


def _files(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    """By category the files of a folder with their ids' number and their digest, told in tasks; a row a file comes here."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    found = raw.select(F.url_decode(F.regexp_extract("path", "/category=([^/]+)/[^/]+$", 1)).alias("category"), F.regexp_extract("path", "(category=[^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "length", (F.length(F.decode("content", "UTF-8")) - F.length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))).cast("long").alias("rows"))
    out: dict[str, list[dict]] = {}
    for r in found.orderBy("category", "name").collect():
        out.setdefault(r.category, []).append({"name": r.name, "rows": r.rows, "bytes": r.length, "sha256": r.sha256})
    return out


def commit(rows: DataFrame, path: str, thresholds: dict[str, float], *, rows_per_file: int = 1_000_000) -> dict:
    """Write rows(category, subject_id), sorted, in files of at most so many ids, then the manifest with thresholds, counts, files and digests. Each call makes a new version; a stop before its manifest is written leaves the last one as it was. Ids have no line ends."""
    spark = rows.sparkSession
    store, folder = Store(spark, path), f"ids-{uuid.uuid4().hex}"
    ids = rows.select("category", F.col("subject_id").cast("string").alias("value")).repartitionByRange("category", "value").sortWithinPartitions("category", "value")
    ids.write.partitionBy("category").option("maxRecordsPerFile", rows_per_file).text(f"{path}/{folder}")
    files = _files(spark, f"{path}/{folder}")
    splits = {c: {"count": sum(f["rows"] for f in fs), "files": fs} for c, fs in files.items()}
    found = {"version": len(store.names("manifests")) + 1, "thresholds": thresholds, "folder": folder, "splits": splits}
    store.write(f"manifests/{found['version']:012d}.json", json.dumps(found, indent=1, sort_keys=True))
    return found


def latest(spark: SparkSession, path: str) -> dict:
    store = Store(spark, path)
    names = store.names("manifests")
    if not names:
        raise FileNotFoundError(f"{path} has no manifest")
    return json.loads(store.read(f"manifests/{names[-1]}"))


def read(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """(category, subject_id) of the newest manifest, of some categories or all; fails where a file is missing, changed or not told of."""
    found = latest(spark, path)
    there = _files(spark, f"{path}/{found['folder']}") if found["splits"] else {}
    for category in found["splits"].keys() | there.keys():
        if there.get(category) != found["splits"].get(category, {}).get("files"):
            raise ValueError(f"the files of {category} aren't those of the manifest")
    chosen = [f["name"] for c, s in found["splits"].items() if categories is None or c in categories for f in s["files"]]
    if not chosen:
        return spark.createDataFrame([], "category string, subject_id string")
    text = spark.read.option("basePath", f"{path}/{found['folder']}").schema("value string, category string").text([f"{path}/{found['folder']}/{n}" for n in chosen])
    return text.select("category", F.col("value").alias("subject_id"))
