"""Tables that are made once for the files they are made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import folder
from .versions import Store

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The application's folder for them, in the one that driver and executors share."""
    return _roots.setdefault(spark.sparkContext.applicationId, f"{folder(spark)}-cache")


def digest(spark: SparkSession, paths: list[str]) -> str:
    """Of the names, sizes and times of change of the files at these paths, folders with all below; a path that isn't there counts as empty."""
    h = hashlib.sha256()
    for path in paths:
        store = Store(spark, path)
        found = []
        if store.fs.exists(store.path("")):
            files = store.fs.listFiles(store.path(""), True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()}\t{f.getLen()}\t{f.getModificationTime()}")
        h.update("\n".join([path, *sorted(found), ""]).encode())
    return h.hexdigest()


def cached(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], *, at: str | None = None) -> DataFrame:
    """make(), written once: read again while the files at `inputs` are the same, made anew and the old one removed when they aren't.

    A table is whole when it has its own name: it's written under another one and moved. Tables of other inputs with this name stay.
    at: a folder to keep them in; by default they last as long as the application.
    """
    store = Store(spark, f"{at or root(spark)}/{name}")
    of = hashlib.sha256("\n".join(inputs).encode()).hexdigest()[:16]
    own = f"{of}-{digest(spark, inputs)}"
    if own not in store.names(""):
        hidden = f"_{own}-{folder(spark).rsplit('/', 1)[-1]}"
        make().write.parquet(f"{store.root}/{hidden}")
        if not store.fs.rename(store.path(hidden), store.path(own)) and own not in store.names(""):
            raise OSError(f"{store.root}/{own} can't be written")
        for old in store.names(""):
            if old.startswith(f"{of}-") and old != own:
                store.remove(old)
    return spark.read.parquet(f"{store.root}/{own}")
