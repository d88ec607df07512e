"""Documents told apart by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc", "same"]


def key_of(doc_id: str, text: str) -> dict[str, Column]:
    """doc (the id, or the least long for null) and same (a hash of the text)."""
    return {"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "same": F.xxhash64(text)}


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, doc, same)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns(key_of("doc_id", "text"))
