"""A corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import decontam, importance, jaccard_join, packing, queries, suffix_dedup
from tallyvox.llm.scratch import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good, non-toxic text draws; the others go.

    Null and empty texts weigh as raw text does and stay where clean text does; very long texts are weighed whole; repeated rows
    with one id share their fate; rows with equal keys at the border all stay. Of an empty table nothing comes out. Without
    target labels all stay.
    """
    _, kept = importance.select(docs, queries.targets(spark, sf_dir))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, that with the least id; one row of repeated ones.

    Texts without words (null, empty, blank) have no links and stay, repeated or not. Ids that are null come last; of equal ids
    the text with the least hash counts. Very long texts are compared whole. Of an empty table nothing comes out.
    """
    return jaccard_join.one_of_each(docs, shingle=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes (passages of some 40 words) that occur again, n_chars counted anew; emptied documents go.

    Null, empty and short texts stay as they are; repeated rows are copies of each other, so what they share goes from all of
    them. Very long texts are searched whole. Of an empty table nothing comes out.
    """
    return suffix_dedup.remove(docs, length=200).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item, or a whole shorter item.

    Null and empty texts have no words and stay; repeated rows share their fate; very long texts are searched whole. Of an
    empty table nothing comes out.
    """
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of 1024 ids. A null or empty text is its end id alone; repeated rows are packed again; a null id stays null. Of an empty table nothing comes out."""
    pieces = packing.pack(docs, queries.tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("benchmark_leaks", benchmark_leaks), ("packing", packed)]
#: Resampling, components and tokenizing are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
