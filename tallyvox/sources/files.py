"""Discovery and pairing of files, as DataFrame operations over a listing (path, and rater where there are several)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import numeric_key, subject_of


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, folder, size, modified); contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", name_of(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def by_pattern(files: DataFrame, patterns: list[str], by: list[str]) -> DataFrame:
    """Of each group the files that match the first pattern (a regular expression) that any of them matches."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("name").rlike(p), i).otherwise(rank)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    best = ranked.groupBy(*by).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*by, "_rank"]).drop("_rank").withColumn("subject_id", subject_of(F.col("name")))


def first_layout(layouts: list[DataFrame]) -> DataFrame:
    """The rows of the first layout that has any."""
    tagged = [d.withColumn("layout", F.lit(i)) for i, d in enumerate(layouts)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    first = out.agg(F.min("layout").alias("layout"))
    return out.join(F.broadcast(first), "layout")  # one row


def cases(files: DataFrame, scans: list[str], masks: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """(subject_id, ct_path, mask_path, organs): subject folders with a scan; the combined mask, else the organs' files under the first of their aliases. Files are matched by name in one aggregate."""
    name, path = F.col("name"), F.col("path")
    first = lambda names: F.coalesce(*[F.min(F.when(name == n, path)) for n in names])
    organs = [first(v).alias(k) for k, v in aliases.items()]
    rows = files.groupBy(F.col("folder").alias("subject_id")).agg(first(scans).alias("ct_path"), first(masks).alias("mask_path"), *organs)
    listed = F.map_filter(F.create_map(*[x for k in aliases for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    return rows.where("ct_path is not null").select("subject_id", "ct_path", "mask_path", F.when(F.col("mask_path").isNull(), listed).alias("organs"))


def paired(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(subject_id, gt_path, pred_path): pairs by full id, else by the 6 to 8 digits in it, the least path of several. gt, pred: (subject_id, path)."""
    exact = pred.groupBy("subject_id").agg(F.min("path").alias("p1"))
    keyed = pred.withColumn("k", numeric_key(F.col("subject_id"))).where("k is not null").groupBy("k").agg(F.min("path").alias("p2"))
    rows = gt.withColumn("k", numeric_key(F.col("subject_id"))).join(exact, "subject_id", "left").join(keyed, "k", "left")
    return rows.select("subject_id", F.col("path").alias("gt_path"), F.coalesce("p1", "p2").alias("pred_path"))


def aliases_of(subject: Column, prefix: str = "BDMAP_") -> Column:
    """An id, the id without its prefix, and that without leading zeros."""
    bare = F.replace(subject, F.lit(prefix), F.lit(""))
    return F.array_distinct(F.array(subject, bare, F.regexp_replace(bare, "^0+", "")))


def _piece(path: Column, n: int):
    return lambda i: F.substr(path, i, F.lit(n))


#: Aliases that are sent to all tasks; with more, they and the paths' pieces are joined by a shuffle.
SENT_ALIASES = 1 << 18


def by_alias(subjects: DataFrame, files: DataFrame, prefix: str = "BDMAP_", sent: int = SENT_ALIASES) -> DataFrame:
    """(subject_id, alias, path): the file whose path has an alias of the subject, by the first alias with any; consensus files first, then by path.

    A path is cut into all its pieces that are as long as some alias, and pieces are joined with aliases by equality, so that no
    path is held against every alias. There are few lengths of aliases.
    """
    wanted = subjects.select("subject_id", F.posexplode(aliases_of(F.col("subject_id"), prefix)).alias("nth", "alias")).where("alias <> ''")
    known = wanted.groupBy(F.length("alias").alias("n")).agg(F.count("*").alias("m")).collect()  # a row for each length
    path = F.col("path")
    empty = F.array().cast("array<string>")
    pieces = [F.when(F.length(path) >= r.n, F.transform(F.sequence(F.lit(1), F.length(path) - r.n + 1), _piece(path, r.n))).otherwise(empty) for r in known]
    cut = files.select("path", F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("alias")) if known else files.select("path", F.lit(None).cast("string").alias("alias"))
    hits = cut.join(F.broadcast(wanted) if sum(r.m for r in known) <= sent else wanted, "alias")
    first = F.min(F.struct("nth", (~F.contains(F.lower("path"), F.lit("consensus"))).alias("plain"), "path", "alias"))
    return hits.groupBy("subject_id").agg(first.alias("m")).select("subject_id", "m.alias", "m.path")


def resolved_label(subjects: DataFrame, files: DataFrame) -> DataFrame:
    """(subject_id, kind, path): a combined gi_mask, else a segmentations folder, else null."""
    rows = files.groupBy(F.col("subject_id")).agg(F.min(F.when(F.col("name") == "gi_mask.nii.gz", F.col("path"))).alias("m"), F.min(F.when(F.contains(F.col("path"), F.lit("/segmentations/")), F.regexp_replace("path", "/[^/]+$", ""))).alias("s"))
    kind = F.when(F.col("m").isNotNull(), "combined").when(F.col("s").isNotNull(), "segmentations")
    return subjects.join(rows, "subject_id", "left").select("subject_id", kind.alias("kind"), F.coalesce("m", "s").alias("path"))


def merged(voxels: DataFrame, by: list[str], **labels: Column) -> DataFrame:
    """(by, x, y, z, labels): one label a voxel from organs' separate masks for each of these rules, all in one pass."""
    return voxels.groupBy(*by, "x", "y", "z").agg(*[c.alias(name) for name, c in labels.items()])


def highest_organ() -> Column:
    return F.max("organ")


def last_file() -> Column:
    """The organ of the last file by name."""
    return F.max(F.struct("name", "organ"))["organ"]


def merged_organs(voxels: DataFrame, by: list[str]) -> DataFrame:
    """One label a voxel from organs' separate masks: the highest organ wins."""
    return merged(voxels, by, label=highest_organ())


def merged_by_file(voxels: DataFrame, by: list[str]) -> DataFrame:
    """As merged_organs, but the last file by name wins."""
    return merged(voxels, by, label=last_file())


def synthetic_cohort(subjects: DataFrame, seed: int = 42, size: int = 32) -> DataFrame:
    """(subject_id, x, y, z, label, hu) for each of subjects(subject_id): four adjacent boxes in a cube, and Gaussian noise."""
    edges = [4, 12, 18, 24, 30]
    side = F.sequence(F.lit(0), F.lit(size - 1))
    rows = subjects.select("subject_id")
    for c in "xyz":
        rows = rows.withColumn(c, F.explode(side))
    label = F.lit(0)
    for k in range(4):
        label = F.when(F.col("x").between(edges[k], edges[k + 1] - 1) & F.col("y").between(4, 11) & F.col("z").between(4, 11), k + 1).otherwise(label)
    return rows.withColumn("label", label).withColumn("hu", F.randn(seed) * 100)
