"""A folder watched as a stream of files. Spark's own file source remembers what it has seen, so a restart goes on from there."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.versions import VersionedTable


def watch(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 1, kind: str = "parquet", partial: str = "_partial") -> DataFrame:
    """Rows of new files, files being written (by their name) left out."""
    rows = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.where(~F.contains(F.col("_metadata.file_name"), F.lit(partial)))


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """handle(rows, batch id) for each batch: all that is there now, or every so often for good."""
    out = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def upsert(stream: DataFrame, table: VersionedTable, checkpoint: str, *, writer: str = "stream", latest: str | None = None, every: str | None = None) -> StreamingQuery:
    """Each batch into the table by its key, once: a batch that is repeated after a stop is known by its number."""
    return process(stream, lambda rows, batch: table.upsert(rows, batch, writer, latest=latest), checkpoint, every=every)


class Watched(StreamingQueryListener):
    """Tells when one query has made progress, or has ended."""

    def __init__(self, query: str):
        self.query, self.moved = query, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query:
            self.moved.set()

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.query:
            self.moved.set()

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.moved.set()


def until(stream: DataFrame, target: int, into: str, checkpoint: str, *, merged: Callable[[], bool] = lambda: False, every: str = "1 second", most: float = 3600) -> None:
    """Count a stream's rows until there are `target`, or merged() says that the merged file is there; then end the query.

    Each batch adds a row (batch, n, percent, finished) below `into`, a folder a batch, so a repeated one replaces its own; n counts
    from the first batch, also after a restart. What comes after the end is not counted. A listener wakes this thread; a query that
    fails raises its error here, and after `most` seconds a TimeoutError ends it.
    """
    spark, done = stream.sparkSession, threading.Event()
    state = {"last": -1, "n": 0}
    counts = "batch int, rows long, n long, percent double, finished boolean"

    def count(rows: DataFrame, batch: int) -> None:
        if done.is_set():
            return
        if batch != state["last"] + 1 or batch == 0:  # at the start, or again: from what is there
            state["n"] = before(batch)
        n = rows.count()
        row = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(n).cast("long").alias("rows"), F.lit(state["n"] + n).cast("long").alias("n"))
        row = row.withColumns({"percent": F.least(F.round(100 * F.col("n") / target, 1), F.lit(100.0)), "finished": F.lit(bool(merged())) | (F.col("n") >= target)})
        row.write.mode("overwrite").parquet(f"{into}/batch={batch}")
        state.update(last=batch, n=state["n"] + n)
        if merged() or state["n"] >= target:
            done.set()

    def before(batch: int) -> int:
        if batch == 0:
            return 0
        return spark.read.schema(counts).parquet(into).where(F.col("batch") < batch).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    query = process(stream, count, checkpoint, every=every)
    listener = Watched(str(query.id))
    spark.streams.addListener(listener)
    end = time.monotonic() + most
    try:
        while query.isActive and not done.is_set() and not merged():
            if time.monotonic() > end:
                raise TimeoutError(f"{state['n']} of {target} after {most} seconds")
            listener.moved.wait(1)
            listener.moved.clear()
        if not query.isActive and query.exception():
            raise query.exception()
    finally:
        query.stop()
        spark.streams.removeListener(listener)


def running_counts(stream: DataFrame, by: str, name: str, checkpoint: str) -> StreamingQuery:
    """Counts by a column in a memory table."""
    return stream.groupBy(by).agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: DataFrame, target: int, *, merged: bool = False) -> DataFrame:
    """(n, percent, finished): counts against a target, capped at 100; finished when merged, or when all are there."""
    n = done.agg(F.count("*").alias("n"))
    return n.select("n", F.least(F.round(100 * F.col("n") / target, 1), F.lit(100.0)).alias("percent"), (F.lit(merged) | (F.col("n") >= target)).alias("finished"))


def elapsed(begin: Column, end: Column) -> tuple[Column, Column]:
    """(minutes to one digit, HH:MM:SS) between two timestamps, in whole seconds."""
    s = F.unix_timestamp(end) - F.unix_timestamp(begin)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.round(s / 60, 1), clock
