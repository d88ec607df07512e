"""A table of rows by key in buckets, changed as a whole or not at all.

A commit writes the buckets that it changes as new files, then a manifest that names the folder of every bucket, under another
name, and last moves it to its own name, which no other commit can take. Readers take the manifest with the highest number. A job
that is stopped at any point before the move leaves files that no manifest names; it's done again with the same result, as a
batch that a manifest already has is left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table. A manifest has an entry for each, so it doesn't grow with rows.
BUCKETS = 64


class Store:
    """Small files by Hadoop's file system, so any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write under another name, then move: whoever sees the file sees all of it. Fails if it's there already."""
        hidden = f"_{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(hidden), self.path(name)):
            self.fs.delete(self.path(hidden), False)
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """Rows of one schema with a key column; each row's bucket is the key's hash."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.store = Store(spark, self.path)
        self.buckets = self.manifest().get("buckets", buckets)

    def manifest(self) -> dict:
        """The newest: its version, the folder of each bucket, and the last batch of each writer."""
        names = self.store.names("manifests")
        return json.loads(self.store.read(f"manifests/{names[-1]}")) if names else {"version": 0, "folders": {}, "batches": {}}

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The rows of the newest version, of some buckets or all."""
        now = self.manifest()["folders"]
        chosen = [now[b] for b in (now if buckets is None else buckets) if b in now]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{x}" for x in chosen])

    def upsert(self, rows: DataFrame, batch: int, writer: str = "batch", *, latest: str | None = None, between=None) -> bool:
        """Put rows in the place of those with their key. False if this batch of the writer is in the table already, which changes nothing.

        Of several rows with one key that with the greatest `latest` stays, also of a new one and one that is there (of equal ones
        the greatest in the order of columns); without it the new one does. between: called after the files are written and before
        the manifest is, for tests.
        """
        old = self.manifest()
        if old["batches"].get(writer, -1) >= batch:
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        order = F.struct(*([latest] if latest else []), *names)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        last = lambda df: df.groupBy(self.key).agg(F.max_by(F.struct(*names), order).alias("_row")).select("_row.*")
        folder = f"data/{uuid.uuid4().hex}"
        last(rows.select(*names).where(F.col(self.key).isNotNull())).write.parquet(f"{self.path}/{folder}-rows")  # read twice below
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}-rows")
        touched = [str(r[0]) for r in new.select(bucket).distinct().collect()]  # at most as many as buckets
        there = self.read(touched)
        both = last(there.unionByName(new)) if latest else there.join(new.select(self.key), self.key, "left_anti").select(*names).unionByName(new)
        both.select(*names, bucket).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        self.store.remove(f"{folder}-rows")
        if between:
            between()
        folders = old["folders"] | {b: f"{folder}/_bucket={b}" for b in touched}
        found = {"version": old["version"] + 1, "buckets": self.buckets, "folders": folders, "batches": old["batches"] | {writer: batch}}
        self.store.write(f"manifests/{found['version']:012d}.json", json.dumps(found, sort_keys=True))
        return True

    def vacuum(self) -> int:
        """Remove folders that the newest manifest doesn't name, and older manifests. No reader or writer may be at work."""
        now = self.manifest()
        named = {x.split("/")[1] for x in now["folders"].values()}
        gone = [f"data/{x}" for x in self.store.names("data") if x not in named] + [f"manifests/{x}" for x in self.store.names("manifests")[:-1]]
        for name in gone:
            self.store.remove(name)
        return len(gone)
