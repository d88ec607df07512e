"""Splits, manifests, folds, samples and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CLEAN, LEGACY_REJECT, TEACHER, WEAK, autolabel
from ..sources.shared import written


def autolabel_stats(pairs: DataFrame, by: list[str], human: str = "gt", consensus: str = "pred") -> DataFrame:
    out = autolabel(F.col(human), F.col(consensus))
    n = pairs.groupBy(*by).agg(F.count_if(F.col(human) > 0).alias("n_foreground"), F.count_if(out == 255).alias("n_ignore"))
    share = F.when(F.col("n_foreground") > 0, 100 * F.col("n_ignore") / F.col("n_foreground")).otherwise(0.0)
    return n.select(*by, "n_foreground", "n_ignore", F.round(share, 2).alias("pct_ignore"))


def succeeded(df: DataFrame) -> DataFrame:
    """Rows with status SUCCESS; all, where there is no such column."""
    return df.where("status = 'SUCCESS'") if "status" in df.columns else df


def manifest(audit: DataFrame, teacher: DataFrame | None = None, use_weak: bool = True, subject: str = "subject_id") -> DataFrame:
    """(subject_id, ct_path, label_path, category): clean subjects, weak ones, and the teacher's that are in neither."""
    path = lambda kind, suffix: F.concat(F.lit(f"{kind}/"), F.col(subject), F.lit(suffix))
    scan = F.concat(F.lit("data/"), F.col(subject), F.lit("/ct.nii.gz")).alias("ct_path")
    part = lambda df, label, category: df.select(F.col(subject).cast("string").alias("subject_id"), scan, label.alias("label_path"), F.lit(category).alias("category"))
    out = part(audit.where(F.col("triage_category") == CLEAN), path("consensus", "_consensus.nii.gz"), CLEAN)
    if use_weak:
        out = out.unionByName(part(audit.where(F.col("triage_category") == WEAK), path("autolabel", "_autolabel.nii.gz"), WEAK))
    if teacher is not None:
        out = out.unionByName(part(teacher, path("teacher", "_gi_seg.nii.gz"), TEACHER).join(out.select("subject_id"), "subject_id", "left_anti"))
    return out


def split_rows(audit: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(category, subject_id): the subjects of each category, and of the training pool of clean and weak ones."""
    ok = succeeded(audit).where("triage_category is not null")
    return ok.select(F.explode(F.when(F.col("triage_category").isin(CLEAN, WEAK), F.array("triage_category", F.lit("TRAIN_POOL"))).otherwise(F.array("triage_category"))).alias("category"), F.col(subject).cast("string").alias("subject_id"))


def splits(audit: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(category, n, subject_ids sorted) of split_rows(), the lists as one text each: for a report. `manifests.commit()` writes cohorts of any size."""
    return split_rows(audit, subject).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("subject_id")), ",").alias("subject_ids"))


def ranked(df: DataFrame, order: list[Column], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Row numbers from 1. Without `by` rows are numbered over range partitions: a count a partition gives each its offset, so no single task sorts all. The numbered partitions are written once, as range bounds are sampled anew each time they are asked for."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parted = written(parted.select(*df.columns, F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nth")))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).select(*df.columns, name)


def fold_of(rn: Column, n: Column, k: int) -> Column:
    """The fold of a row number: folds are contiguous, and the first n % k have one more."""
    size, extra = F.floor(n / k), n % k
    cut = extra * (size + 1)
    return F.when(rn <= cut, F.floor((rn - 1) / (size + 1))).otherwise(extra + F.floor((rn - 1 - cut) / F.greatest(size, F.lit(1)))).cast("int")


def shuffled(key: Column, seed: int) -> Column:
    """A text to order by: the same shuffle for the same seed wherever and however often it is asked for."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def modulo_shard(rn: Column, shards: int) -> Column:
    return F.pmod(rn - 1, F.lit(shards))


def ceil_chunk(rn: Column, n: Column, workers: int) -> Column:
    return F.floor((rn - 1) / F.ceil(n / workers))


def floor_chunk(rn: Column, n: Column, workers: int) -> Column:
    """Chunks of n // workers; the last takes the rest, and all where there are fewer rows than workers."""
    size = F.floor(n / workers)
    return F.when(size > 0, F.least(F.floor((rn - 1) / F.greatest(size, F.lit(1))), F.lit(workers - 1))).otherwise(workers - 1)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of the seeded shuffle: a sampling operator, its size is its feature."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)


def review_queue(pool: DataFrame, k: int = 10) -> DataFrame:
    """The k most uncertain of pool(subject_id, state, score, seq): of those in triage if there are any, else of the unlabelled; equals in their order, missing scores as 0."""
    some = pool.where("state in ('triage', 'unlabeled')")
    any_ = some.agg(F.max(F.when(F.col("state") == "triage", 1).otherwise(0)).alias("any"))
    chosen = some.crossJoin(F.broadcast(any_)).where((F.col("any") == 0) | (F.col("state") == "triage"))  # one row
    return chosen.select("subject_id", F.coalesce("score", F.lit(0.0)).alias("score"), "seq").orderBy(F.col("score").desc(), "seq").limit(k)


def annotated(pool: DataFrame, done: DataFrame) -> DataFrame:
    """pool after the subjects in `done` are labelled: each once, out of the other states."""
    named = done.select("subject_id").distinct()
    rest = pool.join(named, "subject_id", "left_anti")
    return rest.unionByName(named.withColumn("state", F.lit("labeled")), allowMissingColumns=True)


def queue_state(category: Column) -> Column:
    return F.when(category == LEGACY_REJECT, "triage").otherwise("unlabeled")


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Keep-first deduplication with an explicit order: an aggregate, so rows are combined before the shuffle and a key with very many needs no sort."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in by else F.col("_first")[c].alias(c) for c in df.columns])


def unfinished(subjects: DataFrame, done: DataFrame, key: str = "subject_id") -> DataFrame:
    """Subjects without a SUCCESS row."""
    return subjects.join(succeeded(done), key, "left_anti")


def integrity(rows: DataFrame, files: DataFrame, every: int = 10) -> DataFrame:
    """rows(seq, subject_id, ct_path, label_path) with the errors found: missing files, and for every so many rows differing shapes or a scan that isn't 3-D. files: (path, shape)."""
    ct = files.select(F.col("path").alias("ct_path"), F.col("shape").alias("ct_shape"))
    label = files.select(F.col("path").alias("label_path"), F.col("shape").alias("label_shape"))
    both = rows.join(ct, "ct_path", "left").join(label, "label_path", "left")
    deep = F.col("seq") % every == 0
    errors = F.array_compact(F.array(
        F.when(F.col("ct_shape").isNull(), "missing ct"), F.when(F.col("label_shape").isNull(), "missing label"),
        F.when(deep & (F.slice("ct_shape", 1, 3) != F.slice("label_shape", 1, 3)), "shapes differ"), F.when(deep & (F.size("ct_shape") != 3), "ct is not 3-D"),
        F.when(deep & ~F.size("label_shape").isin(3, 4), "label is not 3-D or 4-D"),
    ))
    return both.withColumn("errors", errors)


def missing_deliverables(subjects: DataFrame, made: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """(key, missing): subjects that lack files of some kind, with these kinds in order. made: (key, kind). The kinds are a parameter."""
    have = made.where(F.col("kind").isin(*kinds)).groupBy(key).agg(F.collect_set("kind").alias("have"))
    missing = F.array_except(F.array(*[F.lit(k) for k in sorted(kinds)]), F.coalesce("have", F.array().cast("array<string>")))
    return subjects.join(have, key, "left").select(key, missing.alias("missing")).where(F.size("missing") > 0).select(key, F.array_join("missing", ",").alias("missing"))
