"""Queries of curation, joins, folds, queues and reports."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import agreement, curate, report, surface, topology
from ..sources import files, manifests, tables
from ..sources.cache import cached
from ..sources.shared import folder, written
from . import views
from .agreement import AUDIT_SQL, BETTI_SQL, audit, elements_in_place
from .registry import query, table
from .views import PLACED_SQL, WIDE_SQL


def named_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit with string ids and a status: every 17th subject failed and has no category."""
    a = audit(spark, sf_dir).withColumn("subject_id", F.format_string("S%05d", "subject")).drop("subject")
    bad = F.substring("subject_id", 2, 5).cast("int") % 17 == 0
    return a.withColumn("status", F.when(bad, "ERROR: boom").otherwise("SUCCESS")).withColumn("triage_category", F.when(~bad, F.col("triage_category")))


NAMED_SQL = f"""{AUDIT_SQL}, named AS (SELECT * EXCLUDE (subject, triage_category), printf('S%05d', subject) AS subject_id, CASE WHEN subject % 17 = 0 THEN 'ERROR: boom' ELSE 'SUCCESS' END AS status,
    CASE WHEN subject % 17 <> 0 THEN triage_category END AS triage_category FROM triaged)"""


@query(f"""WITH RECURSIVE {NAMED_SQL}, b AS (SELECT subject_id, triage_category AS category FROM named WHERE status = 'SUCCESS' UNION ALL
  SELECT subject_id, 'TRAIN_POOL' FROM named WHERE status = 'SUCCESS' AND triage_category IN ('CLEAN_HIGH_CONFIDENCE', 'WEAK_COARSE'))
SELECT category, count(*) AS n, string_agg(subject_id, ',' ORDER BY subject_id) AS subject_ids FROM b GROUP BY category""")
def p16_p17_k06_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.splits(named_audit(spark, sf_dir))


@query(f"""WITH RECURSIVE {NAMED_SQL}, teacher AS (SELECT DISTINCT printf('S%05d', user_id * 3) AS subject_id FROM events),
m AS (SELECT subject_id, 'consensus/' || subject_id || '_consensus.nii.gz' AS label_path, triage_category AS category FROM named WHERE triage_category = 'CLEAN_HIGH_CONFIDENCE'
  UNION ALL SELECT subject_id, 'autolabel/' || subject_id || '_autolabel.nii.gz', triage_category FROM named WHERE triage_category = 'WEAK_COARSE')
SELECT subject_id, 'data/' || subject_id || '/ct.nii.gz' AS ct_path, label_path, category FROM m UNION ALL
SELECT subject_id, 'data/' || subject_id || '/ct.nii.gz', 'teacher/' || subject_id || '_gi_seg.nii.gz', 'AUTO_TOTALESEARCHATOR' FROM teacher WHERE subject_id NOT IN (SELECT subject_id FROM m)""")
def u05_j10_p20_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    teacher = table(spark, sf_dir, "events").select(F.format_string("S%05d", F.col("user_id") * 3).alias("subject_id")).distinct()
    return curate.manifest(named_audit(spark, sf_dir), teacher)


@query(f"""WITH RECURSIVE {NAMED_SQL}, s AS (SELECT DISTINCT printf('S%05d', user_id) AS subject_id FROM events)
SELECT subject_id FROM s WHERE subject_id NOT IN (SELECT subject_id FROM named WHERE status = 'SUCCESS')""")
def j11_j12_r06_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = table(spark, sf_dir, "events").select(F.format_string("S%05d", "user_id").alias("subject_id")).distinct()
    return curate.unfinished(subjects, named_audit(spark, sf_dir))


@query("""WITH f AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id FROM f WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id HAVING count(*) = 3""")
def j01_u03_common_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    return f.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n = 3").select("user_id")


@query("""SELECT doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'missing_prediction' ELSE 'present' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j05_p18_ground_truth_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return d.join(labels, "doc_id", "left").select("doc_id", "quality", F.when(F.col("there"), "present").otherwise("missing_prediction").alias("status"))


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j06_m42_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tallies(j05_p18_ground_truth_left(spark, sf_dir), "status", ["present", "missing_prediction"]).select(F.col("present").alias("matched"), F.col("missing_prediction").alias("missing"))


@query("""SELECT page_id, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS num, nullif(regexp_extract(printf('BDMAP_%08d', page_id) || '_gi_seg.nii.gz', '([0-9]{6,8})', 1), '') AS key,
  printf('BDMAP_%08d', page_id) AS subject FROM pages""")
def p19_s12_parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("BDMAP_%08d_gi_seg.nii.gz", "page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("num"), rules.numeric_key(name).alias("key"), rules.subject_of(name).alias("subject"))


@query("""WITH g AS (SELECT printf('BDMAP_%08d', page_id) AS subject_id FROM pages), p AS (SELECT CASE WHEN page_id % 3 = 0 THEN printf('BDMAP_%08d', page_id) WHEN page_id % 3 = 1 THEN printf('X%08d_pred', page_id) ELSE 'none' END AS id, 'pred/' || page_id AS path FROM pages)
SELECT g.subject_id, 'gt/' || g.subject_id AS gt_path, coalesce(min(a.path), min(b.path)) AS pred_path FROM g LEFT JOIN p a ON a.id = g.subject_id LEFT JOIN p b ON regexp_extract(b.id, '([0-9]{6,8})', 1) = regexp_extract(g.subject_id, '([0-9]{6,8})', 1) GROUP BY g.subject_id""")
def s12_j07_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    full = F.format_string("BDMAP_%08d", "page_id")
    pred = pages.select(F.when(F.col("page_id") % 3 == 0, full).when(F.col("page_id") % 3 == 1, F.format_string("X%08d_pred", "page_id")).otherwise("none").alias("subject_id"), F.concat(F.lit("pred/"), F.col("page_id")).alias("path"))
    return files.paired(pages.select(full.alias("subject_id"), F.concat(F.lit("gt/"), full).alias("path")), pred)


FILES_SQL = """files AS (SELECT 'm' || (page_id % 5) AS rater, CASE WHEN page_id % 5 = 0 THEN printf('S%04d_gi_seg.nii.gz', page_id) WHEN page_id % 5 < 3 THEN printf('S%04d_gi_mask.nii.gz', page_id) ELSE printf('S%04d.nii.gz', page_id) END AS name FROM pages
  UNION ALL SELECT 'm' || (page_id % 5), 'notes_' || page_id || '.txt' FROM pages UNION ALL SELECT 'm' || (page_id % 2), printf('T%04d.nii.gz', page_id) FROM pages)"""


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages").select("page_id"), F.col("page_id") % 5
    one = F.when(k == 0, F.format_string("S%04d_gi_seg.nii.gz", "page_id")).when(k < 3, F.format_string("S%04d_gi_mask.nii.gz", "page_id")).otherwise(F.format_string("S%04d.nii.gz", "page_id"))
    rater = lambda n: F.concat(F.lit("m"), F.col("page_id") % n).alias("rater")
    return p.select(rater(5), one.alias("name")).unionByName(p.select(rater(5), F.concat(F.lit("notes_"), F.col("page_id"), F.lit(".txt")).alias("name"))).unionByName(p.select(rater(2), F.format_string("T%04d.nii.gz", "page_id").alias("name")))


@query(f"""WITH {FILES_SQL}, r AS (SELECT *, CASE WHEN name LIKE '%\\_gi\\_seg.nii.gz' ESCAPE '\\' THEN 0 WHEN name LIKE '%\\_gi\\_mask.nii.gz' ESCAPE '\\' THEN 1 WHEN name LIKE '%.nii.gz' THEN 2 END AS k FROM files)
SELECT rater, name, regexp_replace(name, '(_gi_seg|_gi_mask)?\\.nii\\.gz$', '') AS subject_id FROM r WHERE k IS NOT NULL QUALIFY k = min(k) OVER (PARTITION BY rater)""")
def s08_s11_j02_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.by_pattern(file_rows(spark, sf_dir), ["_gi_seg\\.nii\\.gz$", "_gi_mask\\.nii\\.gz$", "\\.nii\\.gz$"], ["rater"])


@query("""WITH a AS (SELECT user_id AS id FROM events WHERE event_type = 'nothing'), b AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click'), c AS (SELECT DISTINCT user_id AS id FROM events)
SELECT id, 1 AS layout FROM b WHERE NOT EXISTS (FROM a) UNION ALL SELECT id, 2 FROM c WHERE NOT EXISTS (FROM a) AND NOT EXISTS (FROM b)""")
def s09_first_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type")
    return files.first_layout([e.where("event_type = 'nothing'").select("id"), e.where("event_type = 'click'").select("id").distinct(), e.select("id").distinct()]).select("id", "layout")


@query("""WITH f AS (SELECT printf('P%04d', conv_id) AS s, CASE turn % 4 WHEN 0 THEN 'ct.nii.gz' WHEN 1 THEN 'stomach.nii.gz' WHEN 2 THEN 'colon.nii.gz' ELSE 'gi_mask.nii.gz' END AS name FROM conversations)
SELECT s AS subject_id, min(s || '/' || name) FILTER (name = 'ct.nii.gz') AS ct_path, min(s || '/' || name) FILTER (name = 'gi_mask.nii.gz') AS mask_path,
  CASE WHEN count(*) FILTER (name = 'gi_mask.nii.gz') = 0 THEN CAST(count(DISTINCT name) FILTER (name IN ('stomach.nii.gz', 'colon.nii.gz')) AS INTEGER) END AS organs FROM f GROUP BY s HAVING count(*) FILTER (name = 'ct.nii.gz') > 0""")
def s10_p25_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 4
    rows = c.select(F.format_string("P%04d", "conv_id").alias("folder"), F.when(t == 0, "ct.nii.gz").when(t == 1, "stomach.nii.gz").when(t == 2, "colon.nii.gz").otherwise("gi_mask.nii.gz").alias("name"))
    rows = rows.withColumn("path", F.concat_ws("/", "folder", "name"))
    found = files.cases(rows, ["ct.nii.gz"], ["gi_mask.nii.gz"], {"stomach": ["stomach.nii.gz"], "colon": ["large_bowel.nii.gz", "colon.nii.gz"]})
    return found.select("subject_id", "ct_path", "mask_path", F.when(F.col("organs").isNotNull(), F.size("organs")).alias("organs"))


# Derived scans and the expert mask they use.
PROPAGATION = {
    "BDMAP_00242113": "BDMAP_00242113.seg.nrrd",
    "BDMAP_00242114": "BDMAP_00242114.seg.nrrd",
    "BDMAP_00242115": "BDMAP_00242113.seg.nrrd",
    "BDMAP_00242116": "BDMAP_00242113.seg.nrrd",
    "BDMAP_00242131": "BDMAP_00242131.seg.nrrd",
    "BDMAP_00242132": "BDMAP_00242131.seg.nrrd",
    "BDMAP_00242133": "BDMAP_00242131.seg.nrrd",
    "BDMAP_00242134": "BDMAP_00242134.seg.nrrd",
    "BDMAP_00242135": "BDMAP_00242136.seg.nrrd",
    "BDMAP_00242136": "BDMAP_00242136.seg.nrrd",
    "BDMAP_00394224": "BDMAP_00394224.seg.nrrd",
}
PROP_SQL = ", ".join(f"('{k}', '{v}')" for k, v in PROPAGATION.items())


def propagation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROPAGATION.items()), "subject_id string, source_file string")


@query(f"""WITH p AS (SELECT * FROM (VALUES {PROP_SQL}) t(subject_id, source_file)), m AS (SELECT DISTINCT event_type AS model FROM events)
SELECT model, subject_id, source_file FROM p CROSS JOIN m""")
def j08_j09_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct()
    return models.crossJoin(F.broadcast(propagation(spark)))  # eleven rows


@query(f"""WITH p AS (SELECT * FROM (VALUES {PROP_SQL}) t(subject_id, source_file)), f AS (SELECT 'out/' || CASE page_id % 3 WHEN 0 THEN 'BDMAP_' ELSE '' END || (242110 + page_id % 30) || CASE page_id % 2 WHEN 0 THEN '_consensus' ELSE '_raw' END || page_id || '.nii.gz' AS path FROM pages),
a AS (SELECT subject_id, unnest([subject_id, replace(subject_id, 'BDMAP_', ''), ltrim(replace(subject_id, 'BDMAP_', ''), '0')]) AS alias, generate_subscripts([1, 2, 3], 1) AS nth FROM p)
SELECT subject_id, alias, path FROM a JOIN f ON contains(path, alias) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY nth, NOT contains(lower(path), 'consensus'), path) = 1""")
def s13_s14_j14_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("out/"), F.when(k % 3 == 0, "BDMAP_").otherwise(""), 242110 + k % 30, F.when(k % 2 == 0, "_consensus").otherwise("_raw"), k, F.lit(".nii.gz"))
    return files.by_alias(propagation(spark).select("subject_id"), table(spark, sf_dir, "pages").select(path.alias("path")))


@query("""WITH f AS (SELECT DISTINCT printf('P%04d', conv_id) AS s, CASE WHEN conv_id % 3 = 0 THEN 'gi_mask.nii.gz' WHEN conv_id % 3 = 1 THEN 'segmentations/colon.nii.gz' ELSE 'ct.nii.gz' END AS tail FROM conversations)
SELECT s AS subject_id, CASE WHEN tail = 'gi_mask.nii.gz' THEN 'combined' WHEN tail LIKE 'seg%' THEN 'segmentations' END AS kind, CASE WHEN tail = 'gi_mask.nii.gz' THEN s || '/' || tail WHEN tail LIKE 'seg%' THEN s || '/segmentations' END AS path FROM f""")
def s15_resolved_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    tail = F.when(F.col("conv_id") % 3 == 0, "gi_mask.nii.gz").when(F.col("conv_id") % 3 == 1, "segmentations/colon.nii.gz").otherwise("ct.nii.gz")
    rows = c.select(F.format_string("P%04d", "conv_id").alias("subject_id"), tail.alias("t")).select("subject_id", F.concat_ws("/", "subject_id", "t").alias("path"), files.name_of(F.col("t")).alias("name"))
    return files.resolved_label(rows.select("subject_id").distinct(), rows)


@query(f"""WITH {views.BOXES_SQL}, o AS (SELECT subject, x, y, z, CASE rater WHEN 'a' THEN 2 ELSE 1 + subject % 4 END AS organ, CASE rater WHEN 'a' THEN 'z.nii.gz' ELSE 'c.nii.gz' END AS name FROM boxes)
SELECT subject, x, y, z, max(organ) AS by_id, arg_max(organ, name) AS by_file FROM o GROUP BY ALL""")
def s17_merged_organs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("rater") == "a"
    v = views.boxes(spark, sf_dir).select("subject", "x", "y", "z", F.when(a, 2).otherwise(1 + F.col("subject") % 4).alias("organ"), F.when(a, "z.nii.gz").otherwise("c.nii.gz").alias("name"))
    return files.merged(v, ["subject"], by_id=files.highest_organ(), by_file=files.last_file())


@query("""WITH g AS (SELECT s.s_suppkey AS s, x.i AS x, y.i AS y, z.i AS z FROM supplier s, (SELECT range AS i FROM range(32)) x, (SELECT range AS i FROM range(32)) y, (SELECT range AS i FROM range(32)) z),
l AS (SELECT printf('DUMMY_%03d', s) AS subject_id, CASE WHEN y BETWEEN 4 AND 11 AND z BETWEEN 4 AND 11 THEN CASE WHEN x BETWEEN 4 AND 11 THEN 1 WHEN x BETWEEN 12 AND 17 THEN 2 WHEN x BETWEEN 18 AND 23 THEN 3 WHEN x BETWEEN 24 AND 29 THEN 4 ELSE 0 END ELSE 0 END AS label FROM g)
SELECT subject_id, label, count(*) AS n FROM l GROUP BY ALL""")
def s16_synthetic_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = views.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.format_string("DUMMY_%03d", F.col("s_suppkey")).alias("subject_id"))
    return files.synthetic_cohort(subjects).groupBy("subject_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {NAMED_SQL} SELECT subject_id, status, mean_consensus_dice, mean_consensus_iou, mean_inter_model_dice, max_betti_diff, mean_uncertainty, max_uncertainty, triage_category FROM named")
def s04_s05_k01_k03_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/audit-csv"
    tables.write_csv(named_audit(spark, sf_dir).select(*tables.AUDIT.names), path)
    return tables.read_shards(spark, path, tables.AUDIT).drop("file", "action")


@query(f"WITH RECURSIVE {NAMED_SQL} SELECT subject_id FROM named WHERE triage_category = 'WEAK_COARSE'")
def s06_k05_text_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/weak-list"
    tables.write_list(named_audit(spark, sf_dir).where(F.col("triage_category") == rules.WEAK), "subject_id", path)
    return tables.read_list(spark, path)


@query(f"""WITH RECURSIVE {NAMED_SQL} SELECT triage_category AS category, count(*) AS n FROM named WHERE status = 'SUCCESS' GROUP BY ALL
UNION ALL SELECT 'TRAIN_POOL', count(*) FROM named WHERE status = 'SUCCESS' AND triage_category <> 'NOISE_REJECT'""")
def s07_k06_json_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/manifest-json"
    limits = {"NOISE_BETTI_DIFF_MAX": rules.NOISE_BETTI_DIFF_MAX, "NOISE_DICE_MIN": rules.NOISE_DICE_MIN, "CLEAN_DICE_MIN": rules.CLEAN_DICE_MIN}
    tables.split_manifest(curate.splits(named_audit(spark, sf_dir)), limits).write.mode("overwrite").text(path)
    back = tables.read_json(spark, path, "thresholds map<string,double>, splits map<string,struct<count:bigint,subject_ids:array<string>>>")
    return back.select(F.explode("splits").alias("category", "v")).select("category", F.col("v.count").alias("n"))


FOLD_SQL = "r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer)"


@query(f"""WITH {FOLD_SQL} SELECT c_custkey, CAST(CASE WHEN rn <= (n % 4) * (n // 4 + 1) THEN (rn - 1) // (n // 4 + 1) ELSE n % 4 + (rn - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS fold,
  CAST((rn - 1) % 7 AS BIGINT) AS modulo, CAST(floor((rn - 1) / ceil(n / 6)) AS BIGINT) AS ceil_chunk, CAST(least((rn - 1) // (n // 6), 5) AS BIGINT) AS floor_chunk, rn <= floor(8e-1 * n) AS train FROM r""")
def r01_r05_shards_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = F.col("n")
    rows = curate.ranked(c, [F.col("c_custkey")]).crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))  # one row
    rn = F.col("rn")
    return rows.select("c_custkey", curate.fold_of(rn, n, 4).alias("fold"), curate.modulo_shard(rn, 7).alias("modulo"), curate.ceil_chunk(rn, n, 6).alias("ceil_chunk"), curate.floor_chunk(rn, n, 6).alias("floor_chunk"), (rn <= F.floor(0.8 * n)).alias("train"))


SHUFFLE_SQL = "r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS rn, count(*) OVER () AS n FROM customer)"


@query(f"""WITH {SHUFFLE_SQL} SELECT c_custkey, CAST(CASE WHEN rn <= (n % 4) * (n // 4 + 1) THEN (rn - 1) // (n // 4 + 1) ELSE n % 4 + (rn - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS fold,
  rn <= CAST(floor(8e-1 * n) AS BIGINT) AS train, rn <= greatest(1, CAST(floor(2e-1 * n) AS BIGINT)) AS validation FROM r""")
def r04_r05_shuffled_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n, rn = F.col("n"), F.col("rn")
    rows = curate.ranked(c, [curate.shuffled(F.col("c_custkey"), 42), F.col("c_custkey")]).crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))  # one row
    return rows.select("c_custkey", curate.fold_of(rn, n, 4).alias("fold"), (rn <= F.floor(0.8 * n)).alias("train"), (rn <= F.greatest(F.lit(1), F.floor(0.2 * n))).alias("validation"))


@query("SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50")
def t04_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def t01_t03_first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


POOL_SQL = f"""{AUDIT_SQL}, pool AS (SELECT printf('S%05d', subject) AS subject_id, CASE WHEN triage_category = 'NOISE_REJECT' THEN 'triage' ELSE 'unlabeled' END AS state, CASE WHEN subject % 11 > 0 THEN mean_uncertainty END AS score, subject AS seq FROM triaged)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("triage_category") == rules.NOISE, "triage").otherwise("unlabeled")
    return audit(spark, sf_dir).select(F.format_string("S%05d", "subject").alias("subject_id"), state.alias("state"), F.when(F.col("subject") % 11 > 0, F.col("mean_uncertainty")).alias("score"), F.col("subject").alias("seq"))


@query(f"WITH RECURSIVE {POOL_SQL} SELECT subject_id, coalesce(score, 0) AS score, seq FROM pool WHERE state = 'triage' ORDER BY coalesce(score, 0) DESC, seq LIMIT 10")
def t02_t05_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.review_queue(pool(spark, sf_dir), 10)


@query(f"WITH RECURSIVE {POOL_SQL} SELECT CASE WHEN seq % 4 = 0 THEN 'labeled' ELSE state END AS state, count(*) AS n FROM pool GROUP BY ALL")
def u06_annotated_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    return curate.annotated(p, p.where("seq % 4 = 0").select("subject_id")).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {POOL_SQL}, q AS (SELECT subject_id FROM pool WHERE state = 'triage' ORDER BY coalesce(score, 0) DESC, seq LIMIT 10), details AS (SELECT printf('S%05d', user_id) AS subject_id, event_type, event_id FROM events WHERE event_type = 'error')
SELECT q.subject_id, coalesce(f.event_type, 'REJECT_OR_TRIAGE') AS detail, coalesce(f.event_id, 0) AS event_id FROM q LEFT JOIN (SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY event_id) = 1) f USING (subject_id)""")
def j13_w02_queue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.format_string("S%05d", "user_id").alias("subject_id"), "event_type", "event_id")
    first = curate.first_rows(d, ["subject_id"], [F.col("event_id")])
    return curate.review_queue(pool(spark, sf_dir), 10).join(first, "subject_id", "left").select("subject_id", F.coalesce("event_type", F.lit(rules.LEGACY_REJECT)).alias("detail"), F.coalesce("event_id", F.lit(0)).alias("event_id"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1")
def w03_u02_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.first_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn"), F.col("role")])


@query("""WITH e AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS epoch, max(l_extendedprice) AS val FROM lineitem GROUP BY ALL)
SELECT l_suppkey, epoch, val FROM e QUALIFY val > coalesce(max(val) OVER (PARTITION BY l_suppkey ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e0)""")
def w05_k08_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.improved(epochs(spark, sf_dir), ["l_suppkey"], "val", "epoch", -1.0)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, epoch, val): the best price of each line number of an order, which can occur twice."""
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("epoch"), F.col("l_extendedprice").alias("val"))
    return e.groupBy("l_suppkey", "epoch").agg(F.max("val").alias("val"))


@query("""WITH e AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS epoch, max(l_extendedprice) AS val FROM lineitem GROUP BY ALL)
SELECT l_suppkey, epoch, val FROM e QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY val DESC, epoch) = 1""")
def w06_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_rows(epochs(spark, sf_dir), ["l_suppkey"], "val", "epoch")


@query("SELECT l_orderkey, l_linenumber, round(1e-6 + (1e-3 - 1e-6) * (1 + cos(pi() * l_linenumber / 7)) / 2, 9) AS rate FROM lineitem")
def w08_cosine_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(rules.cosine_rate(F.col("l_linenumber"), 7, 1e-3), 9).alias("rate"))


@query(f"""WITH RECURSIVE {AUDIT_SQL}, l AS (SELECT CASE WHEN mean_consensus_dice < 5e-1 OR max_betti_diff > 5 THEN 'REJECT_OR_TRIAGE' WHEN mean_consensus_dice >= 82e-2 THEN 'CLEAN_HIGH_CONFIDENCE' ELSE 'WEAK_COARSE' END AS c, mean_consensus_dice AS d FROM audit),
s AS (SELECT count(*) AS n, count(*) FILTER (c = 'REJECT_OR_TRIAGE') AS rejected, avg(d) AS m FROM l)
SELECT n, rejected, round(m, 4) AS mean_dice, CASE WHEN m >= 82e-2 AND 1e0 * rejected / n < 5e-2 THEN 'A' WHEN m >= 65e-2 THEN 'B' ELSE 'C' END AS outcome FROM s""")
def p03_p04_legacy_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir).withColumn("c", rules.legacy_triage(F.col("mean_consensus_dice"), F.col("max_betti_diff")))
    s = a.agg(F.count("*").alias("n"), F.count_if(F.col("c") == rules.LEGACY_REJECT).alias("rejected"), F.avg("mean_consensus_dice").alias("m"))
    return s.select("n", "rejected", F.round("m", 4).alias("mean_dice"), rules.outcome(F.col("m"), F.col("rejected") / F.nullif(F.col("n"), F.lit(0))).alias("outcome"))


COMPARE_SQL = f"""{WIDE_SQL}, c AS (SELECT subject, {", ".join(f"CASE WHEN count(*) FILTER (l1 > 0 OR l{r} > 0) > 0 AND subject % {m} > 0 THEN round(2e0 * count(*) FILTER (l1 > 0 AND l{r} > 0) / (count(*) FILTER (l1 > 0) + count(*) FILTER (l{r} > 0)), 4) END AS {n}" for r, n, m in ((2, "swin", 19), (3, "mednext", 23)))} FROM raters GROUP BY subject),
w AS (SELECT *, CASE WHEN swin IS NULL AND mednext IS NULL THEN 'N/A' WHEN swin IS NULL THEN 'MedNeXt' WHEN mednext IS NULL THEN 'Swin' WHEN mednext > swin + 5e-3 THEN 'MedNeXt' WHEN swin > mednext + 5e-3 THEN 'Swin' ELSE 'Tie' END AS winner FROM c)"""


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.raters_wide(spark, sf_dir)
    d = lambda r, m: F.when((F.count_if((F.col("l1") > 0) | (F.col(r) > 0)) > 0) & (F.first(F.col("subject")) % m > 0), F.round(2 * F.count_if((F.col("l1") > 0) & (F.col(r) > 0)) / (F.count_if(F.col("l1") > 0) + F.count_if(F.col(r) > 0)), 4))
    c = v.groupBy("subject").agg(d("l2", 19).alias("swin"), d("l3", 23).alias("mednext"))
    return c.withColumn("winner", rules.winner(F.col("swin"), F.col("mednext"), ("Swin", "MedNeXt")))


@query(f"WITH {COMPARE_SQL} SELECT subject, swin, mednext, winner FROM w")
def p06_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir)


@query(f"""WITH {COMPARE_SQL} SELECT count(*) FILTER (winner = 'Swin') AS swin, count(*) FILTER (winner = 'MedNeXt') AS mednext, count(*) FILTER (winner = 'Tie') AS ties,
  round(avg(swin), 4) AS swin_mean, round(avg(mednext), 4) AS mednext_mean, CASE WHEN avg(mednext) > avg(swin) THEN 'MedNeXt' ELSE 'Swin' END AS recommended FROM w""")
def m34_m40_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c = F.col("winner"), comparison(spark, sf_dir)
    s = c.agg(*[F.count_if(w == k).alias(n) for k, n in (("Swin", "n_swin"), ("MedNeXt", "n_mednext"), ("Tie", "ties"))], F.avg("swin").alias("a"), F.avg("mednext").alias("b"))
    return s.select(F.col("n_swin").alias("swin"), F.col("n_mednext").alias("mednext"), "ties", F.round("a", 4).alias("swin_mean"), F.round("b", 4).alias("mednext_mean"), F.when(F.col("b") > F.col("a"), "MedNeXt").otherwise("Swin").alias("recommended"))


LONG_SQL = f"""{WIDE_SQL}, {PLACED_SQL},
sided AS (SELECT subject, pair.organ AS organ, pair.rater AS rater, pair.side AS side, x, y, z FROM (SELECT subject, x, y, z, unnest([{{'rater': 'swin', 'side': 'a', 'organ': l1}}, {{'rater': 'mednext', 'side': 'a', 'organ': l1}}, {{'rater': 'swin', 'side': 'b', 'organ': l2}}, {{'rater': 'mednext', 'side': 'b', 'organ': l3}}]) AS pair FROM placed) WHERE pair.organ > 0),
size AS (SELECT subject, organ, rater, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM sided GROUP BY ALL),
tps AS (SELECT a.subject, a.organ, a.rater, count(*) AS tp FROM sided a JOIN sided b ON a.side = 'a' AND b.side = 'b' AND a.subject = b.subject AND a.organ = b.organ AND a.rater = b.rater AND a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY ALL),
faced AS (SELECT b.subject, b.organ, b.rater, b.side, b.x, b.y, b.z FROM sided b LEFT JOIN sided n ON n.subject = b.subject AND n.organ = b.organ AND n.rater = b.rater AND n.side = b.side AND abs(n.x - b.x) + abs(n.y - b.y) + abs(n.z - b.z) = 1 GROUP BY ALL HAVING count(n.x) < 6),
gaps AS (SELECT a.subject, a.organ, a.rater, a.side, a.x, a.y, a.z, min(sqrt(((a.x - b.x) * 15e-1) ** 2 + ((a.y - b.y) * 15e-1) ** 2 + ((a.z - b.z) * 2e0) ** 2)) AS d FROM faced a JOIN faced b ON a.subject = b.subject AND a.organ = b.organ AND a.rater = b.rater AND a.side <> b.side GROUP BY ALL),
far AS (SELECT subject, organ, rater, max(h) AS hd95 FROM (SELECT subject, organ, rater, side, quantile_cont(d, 95e-2) AS h FROM gaps GROUP BY ALL) GROUP BY ALL),
cells AS (SELECT subject, organ, rater FROM (SELECT DISTINCT subject FROM raters), (SELECT unnest([1, 2, 3, 4]) AS organ), (SELECT unnest(['swin', 'mednext']) AS rater)),
long AS (SELECT subject, organ, rater, CASE WHEN coalesce(a + b, 0) > 0 THEN 2e0 * coalesce(tp, 0) / (a + b) ELSE 1e0 END AS dice, hd95 FROM cells LEFT JOIN size USING (subject, organ, rater) LEFT JOIN tps USING (subject, organ, rater) LEFT JOIN far USING (subject, organ, rater))"""


def audit_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, organ, rater, dice, hd95) of two raters against the first; hd95 is missing where a side lacks the organ. Made once for the file it's made from."""
    return cached(spark, "audit-long", [f"{sf_dir}/events.parquet"], lambda: _audit_long(spark, sf_dir))


def _audit_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.placed(spark, sf_dir)
    pair = lambda label, rater: F.struct(F.col(label).alias("pred"), F.lit(rater).alias("rater"))
    pairs = v.select("subject", "x", "y", "z", F.col("l1").alias("gt"), F.explode(F.array(pair("l2", "swin"), pair("l3", "mednext"))).alias("v")).select("subject", "x", "y", "z", "gt", "v.*")
    c = agreement.overlap(agreement.confusion(pairs, ["subject", "rater"])).select("subject", "organ", F.col("rater").alias("model"), "dice")
    sides = F.array(F.struct(F.lit("a").alias("rater"), F.col("gt").alias("organ")), F.struct(F.lit("b").alias("rater"), F.col("pred").alias("organ")))
    masks = pairs.withColumnRenamed("rater", "model").select("subject", "model", "x", "y", "z", F.explode(sides).alias("s")).select("subject", "model", "x", "y", "z", "s.*").where("organ > 0")
    far = surface.surface_distances(masks, ["subject", "organ", "model"], views.SPACING).select("subject", "organ", "model", "hd95")
    return c.join(far, ["subject", "organ", "model"], "left").withColumnRenamed("model", "rater")


@query(f"WITH {LONG_SQL} SELECT rater, round(avg(dice), 4) AS dice, round(avg(hd95), 4) AS hd95 FROM long GROUP BY rater")
def m35_per_model_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.means(audit_long(spark, sf_dir), ["rater"], ["dice", "hd95"])


@query(f"WITH RECURSIVE {AUDIT_SQL} SELECT round(avg(subject), 4) AS subject, round(avg(mean_consensus_dice), 4) AS mean_consensus_dice, round(avg(mean_consensus_iou), 4) AS mean_consensus_iou, round(avg(mean_inter_model_dice), 4) AS mean_inter_model_dice, round(avg(max_betti_diff), 4) AS max_betti_diff, round(avg(mean_uncertainty), 4) AS mean_uncertainty, round(avg(max_uncertainty), 4) AS max_uncertainty FROM audit")
def m36_m39_numeric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numeric_means(audit(spark, sf_dir))


CLUSTER_SQL = """pairs AS (SELECT subject, organ, CAST(l1 = organ AS INTEGER) AS gt, CAST(l2 = organ AS INTEGER) AS pred FROM raters, (SELECT unnest([1, 2, 3, 4]) AS organ)),
cc AS (SELECT subject, organ, gt, pred, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER (PARTITION BY subject, organ, gt) AS a, sum(n) OVER (PARTITION BY subject, organ, pred) AS b FROM cc),
cs AS (SELECT subject, organ, sum(n) AS t, sum(n * n) - sum(n) AS tp, sum(n * a) - sum(n * n) AS fn, sum(n * b) - sum(n * n) AS fp, sum(n) * sum(n) - sum(n * a) - sum(n * b) + sum(n * n) AS tn, -sum(n * (log2(n / a) + log2(n / b))) AS h FROM cm GROUP BY ALL),
clusters AS (SELECT subject, organ, CASE WHEN fn = 0 AND fp = 0 THEN 1e0 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari, h / t AS voi FROM cs)"""


@query(f"""WITH {LONG_SQL}, {CLUSTER_SQL}
SELECT organ, {", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std" for c in ("dice", "hd95", "ari", "voi"))} FROM long JOIN clusters USING (subject, organ) WHERE rater = 'swin' GROUP BY organ""")
def m37_organ_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    organs = views.pairs(spark, sf_dir).withColumn("organ", F.explode(F.array(*[F.lit(k) for k in rules.ORGANS])))
    one = organs.select("subject", "organ", *[(F.col(c) == F.col("organ")).cast("int").alias(c) for c in ("gt", "pred")])
    both = audit_long(spark, sf_dir).where("rater = 'swin'").join(agreement.clustering(one, ["subject", "organ"]), ["subject", "organ"])
    return report.mean_and_std(both, ["organ"], ["dice", "hd95", "ari", "voi"])


@query(f"""WITH RECURSIVE {BETTI_SQL}, diffs AS (SELECT organ, unnest([abs(b1 - b0), abs(b2 - b0), abs(b3 - b0)]) AS betti_diff, unnest([1, 2, 3]) AS rater FROM betti)
SELECT organ, rater, round(avg(betti_diff), 4) AS betti_diff_mean, round(stddev_samp(betti_diff), 4) AS betti_diff_std FROM diffs GROUP BY ALL""")
def m37_betti_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = topology.betti_differences(elements_in_place(spark, sf_dir), 3, list(rules.ORGANS)).select("organ", F.posexplode("differences").alias("rater", "betti_diff"))
    return report.mean_and_std(d.withColumn("rater", F.col("rater") + 1), ["organ", "rater"], ["betti_diff"])


@query(f"""WITH {LONG_SQL} SELECT subject, {", ".join(f"round(max({m}) FILTER (organ = {k} AND rater = '{r}'), 4) AS {n}_{m}_{r}" for k, n in rules.ORGANS.items() for m in ("dice", "hd95") for r in ("swin", "mednext"))} FROM long GROUP BY subject""")
def m44_m45_wide_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{n}_{m}_{r}" for n in rules.ORGANS.values() for m in ("dice", "hd95") for r in ("swin", "mednext")]
    organ = F.element_at(F.array(*[F.lit(x) for x in rules.ORGANS.values()]), F.col("organ"))
    rows = audit_long(spark, sf_dir).unpivot(["subject", "organ", "rater"], ["dice", "hd95"], "metric", "value").withColumn("value", F.round("value", 4))
    return report.wide(rows, ["subject"], F.concat(organ, F.lit("_"), F.col("metric"), F.lit("_"), F.col("rater")), "value", names)


@query(f"""WITH RECURSIVE {BETTI_SQL}, cells AS (SELECT subject, {", ".join(f"max(greatest(abs(b1 - b0), abs(b2 - b0), abs(b3 - b0))) FILTER (organ = {k}) AS {n}_betti_diff" for k, n in rules.ORGANS.items())} FROM betti GROUP BY subject)
SELECT *, coalesce(greatest({", ".join(f"{n}_betti_diff" for n in rules.ORGANS.values())}), 0) AS worst FROM cells""")
def m41_rowwise_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = topology.betti_differences(elements_in_place(spark, sf_dir), 3, list(rules.ORGANS)).withColumn("worst", F.array_max("differences"))
    cells = d.groupBy("subject").agg(*[F.max(F.when(F.col("organ") == k, F.col("worst"))).alias(f"{n}_betti_diff") for k, n in rules.ORGANS.items()])
    return cells.withColumn("worst", F.coalesce(F.greatest(*[F.col(f"{n}_betti_diff") for n in rules.ORGANS.values()]), F.lit(0)))


@query("SELECT node, count(*) AS degree FROM (SELECT unnest(['s' || l_suppkey, 'p' || l_partkey]) AS node FROM lineitem) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def m46_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")))).alias("node"))
    return e.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "node").limit(10)


@query("SELECT event_type, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0) GROUP BY event_type")
def u01_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.unionByName(e.where("event_id % 2 = 0").drop("props"), allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0")
def u04_j17_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").distinct().join(e.where("event_type = 'error' and event_id % 3 = 0").select("user_id"), "user_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE l_linenumber WHEN 1 THEN 'stomach' WHEN 2 THEN 'duodenum' WHEN 3 THEN 'small_bowel' WHEN 4 THEN 'colon' END, 'Unknown (' || l_linenumber || ')') AS organ FROM lineitem")
def j18_organ_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in rules.ORGANS.items() for x in kv])
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.try_element_at(names, k), F.concat(F.lit("Unknown ("), k, F.lit(")"))).alias("organ"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS gold FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l USING (doc_id)")
def p27_gold_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("gold", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(gold, "doc_id", "left").select("doc_id", F.coalesce("gold", F.lit(False)).alias("gold"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE CAST(event_id % 100 AS VARCHAR) END AS DOUBLE) AS number, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 5 END AS masked FROM events")
def p15_p23_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "N/A").otherwise((e % 100).cast("string"))
    label = F.when(e % 13 == 0, rules.IGNORE).otherwise(e % 5)
    return table(spark, sf_dir, "events").select("event_id", rules.number(text).alias("number"), F.when(label == rules.IGNORE, 0).otherwise(label).alias("masked"))


@query("""WITH r AS (SELECT page_id AS seq, 'ct/' || page_id AS ct_path, 'seg/' || page_id AS label_path FROM pages), f AS (SELECT 'ct/' || page_id AS path, CASE WHEN page_id % 20 = 0 THEN [4, 4] ELSE [4, 4, 4] END AS shape FROM pages WHERE page_id % 7 > 0
  UNION ALL SELECT 'seg/' || page_id, CASE WHEN page_id % 30 = 0 THEN [5, 4, 4] ELSE [4, 4, 4] END FROM pages WHERE page_id % 5 > 0 OR page_id % 10 = 0)
SELECT seq, array_to_string(list_filter([CASE WHEN c.shape IS NULL THEN 'missing ct' END, CASE WHEN l.shape IS NULL THEN 'missing label' END, CASE WHEN seq % 10 = 0 AND c.shape <> l.shape[1:3] AND c.shape IS NOT NULL AND l.shape IS NOT NULL THEN 'shapes differ' END,
  CASE WHEN seq % 10 = 0 AND len(c.shape) <> 3 THEN 'ct is not 3-D' END], lambda x: x IS NOT NULL), ';') AS errors FROM r LEFT JOIN f c ON c.path = ct_path LEFT JOIN f l ON l.path = label_path""")
def r09_r10_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages").select("page_id"), F.col("page_id")
    shape = lambda *n: F.array(*[F.lit(i) for i in n])
    path = lambda kind: F.concat(F.lit(f"{kind}/"), k)
    there = p.where(k % 7 > 0).select(path("ct").alias("path"), F.when(k % 20 == 0, shape(4, 4)).otherwise(shape(4, 4, 4)).alias("shape"))
    there = there.unionByName(p.where((k % 5 > 0) | (k % 10 == 0)).select(path("seg").alias("path"), F.when(k % 30 == 0, shape(5, 4, 4)).otherwise(shape(4, 4, 4)).alias("shape")))
    rows = p.select(k.alias("seq"), path("s").alias("subject_id"), path("ct").alias("ct_path"), path("seg").alias("label_path"))
    return curate.integrity(rows, there).select("seq", F.array_join("errors", ";").alias("errors"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def r07_r08_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import monitor
    at = folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(4).write.parquet(f"{at}/arrived")

    def keep(rows: DataFrame, batch: int) -> None:
        tables.append_partition(rows.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch)), f"{at}/counts", "batch")

    monitor.process(monitor.watch(spark, f"{at}/arrived", e.schema), keep, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/counts").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n, least(round(100e0 * count(*) / 100, 1), 100) AS percent, count(*) >= 100 AS finished FROM (SELECT DISTINCT user_id FROM events)")
def r08_r11_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import monitor

    return monitor.progress(table(spark, sf_dir, "events").select("user_id").distinct(), 100)


@query(f"WITH {WIDE_SQL}, n AS (SELECT subject, l1, count(*) AS n FROM raters GROUP BY ALL) SELECT subject, l1, round(1e0 * n / sum(n) OVER (PARTITION BY subject), 4) AS share FROM n")
def w07_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.raters_wide(spark, sf_dir).groupBy("subject", "l1").agg(F.count("*").alias("n"))
    return n.select("subject", "l1", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("subject")), 4).alias("share"))


@query(f"""WITH RECURSIVE {AUDIT_SQL}, n AS (SELECT triage_category AS c, count(*) AS n FROM triaged GROUP BY ALL)
SELECT printf('%-24s %6d (%6.2f%%)', c, n, 100e0 * n / (SELECT sum(n) FROM n)) AS line FROM n""")
def k10_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lines(report.value_counts(audit(spark, sf_dir), "triage_category", 6), "triage_category")


@query(f"WITH {WIDE_SQL} SELECT subject, element, l1 AS gt, CASE WHEN element % 3 = 0 THEN 0 ELSE l2 END AS pred FROM raters")
def j03_co_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = views.raters(spark, sf_dir).where("rater <> 2 or element % 3 <> 0")  # the second rater leaves elements out
    return agreement.co_located(votes, 1, 2, ["subject", "element"])


@query(f"""WITH RECURSIVE {NAMED_SQL} SELECT subject_id, triage_category, CASE WHEN status = 'SUCCESS' THEN 'first' END AS kind FROM named WHERE status = 'SUCCESS' UNION ALL SELECT subject_id, triage_category, 'second' FROM named""")
def p26_column_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = written(named_audit(spark, sf_dir))
    first, second = curate.succeeded(a).withColumn("kind", F.lit("first")), curate.succeeded(a.drop("status")).withColumn("kind", F.lit("second"))
    return first.unionByName(second, allowMissingColumns=True).select("subject_id", "triage_category", "kind")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events), k AS (SELECT unnest(['consensus', 'uncertainty']) AS kind),
f AS (SELECT DISTINCT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'consensus' ELSE 'uncertainty' END AS kind FROM events WHERE event_type IN ('click', 'purchase') AND value > 12e1)
SELECT s.user_id, string_agg(k.kind, ',' ORDER BY k.kind) AS missing FROM s CROSS JOIN k LEFT JOIN f ON f.user_id = s.user_id AND f.kind = k.kind WHERE f.user_id IS NULL GROUP BY s.user_id""")
def r11_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    made = e.where("event_type in ('click', 'purchase') and value > 120").select("user_id", F.when(F.col("event_type") == "click", "consensus").otherwise("uncertainty").alias("kind"))
    return curate.missing_deliverables(e.select("user_id").distinct(), made, "user_id", ["consensus", "uncertainty"])


@query("""WITH first AS (SELECT p_partkey AS id, p_size AS v, (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS batch FROM part WHERE p_partkey % 4 > 0)
SELECT id, CASE WHEN id % 5 = 0 THEN v + 100 ELSE v END AS v, batch FROM first
UNION ALL SELECT p_partkey, p_size + 100, (SELECT max(batch) + 1 FROM first) + (row_number() OVER (ORDER BY p_partkey) - 1) // 50 FROM part WHERE p_partkey % 20 = 0""")
def k02_checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, p = folder(spark), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("v"))
    tables.checkpoint(p.where("id % 4 > 0"), at, "id", every=50)
    tables.upsert(spark, at, p.where("id % 5 = 0").withColumn("v", F.col("v") + 100), "id", every=50)
    return spark.read.parquet(at).select("id", "v", F.col("batch").cast("long").alias("batch"))


@query("""WITH s AS (SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS s FROM events GROUP BY user_id)
SELECT user_id, round(s / 6e1, 1) AS minutes, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM s""")
def r07_elapsed_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import monitor

    minutes, clock = monitor.elapsed(F.col("a"), F.col("b"))
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", minutes.alias("minutes"), clock.alias("clock"))


@query("""WITH r AS (SELECT user_id AS subject, event_id AS seen, round(value, 6) AS value FROM events)
SELECT subject, max(seen) AS seen, round(max_by(value, seen), 6) AS value, count(*) AS n FROM r GROUP BY subject""")
def k02_r06_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's newest row by a stream into a versioned table; the first run is stopped between a batch's files and its manifest, and the stream goes on from its checkpoint."""
    from ..sources.versions import VersionedTable
    from ..streaming import monitor

    at = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("seen"), F.round("value", 6).alias("value"))
    e.repartition(3).write.parquet(f"{at}/arrived")
    kept = VersionedTable(spark, f"{at}/table", "subject long, seen long, value double", "subject", buckets=8)

    def stop() -> None:
        raise InterruptedError("stopped between files and manifest")

    def broken(rows: DataFrame, batch: int) -> None:
        kept.upsert(rows, batch, "stream", latest="seen", between=stop if batch == 1 else None)

    watch = lambda: monitor.watch(spark, f"{at}/arrived", e.schema)
    try:
        monitor.process(watch(), broken, f"{at}/checkpoint").awaitTermination()
    except StreamingQueryException:
        pass
    monitor.upsert(watch(), kept, f"{at}/checkpoint", latest="seen").awaitTermination()
    return kept.read().join(e.groupBy("subject").agg(F.count("*").alias("n")), "subject").select("subject", "seen", "value", "n")


@query("""WITH c AS (SELECT event_id % 5 AS batch, count(*) AS rows FROM events GROUP BY ALL), n AS (SELECT batch, rows, sum(rows) OVER (ORDER BY batch) AS n, (SELECT count(*) // 2 FROM events) AS target FROM c)
SELECT CAST(batch AS INTEGER) AS batch, rows, CAST(n AS BIGINT) AS n, least(round(100e0 * n / target, 1), 100) AS percent, n >= target AS finished FROM n WHERE n - rows < target""")
def r08_monitor_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that ends its query by itself when half of all events are there: a row for each batch."""
    from ..streaming import monitor

    at = folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    for part in range(5):  # five files, one after the other
        e.where(F.col("event_id") % 5 == part).coalesce(1).write.mode("append").parquet(f"{at}/arrived")
    monitor.until(monitor.watch(spark, f"{at}/arrived", e.schema), e.count() // 2, f"{at}/progress", f"{at}/checkpoint", every="0 seconds")
    return spark.read.schema("batch int, rows long, n long, percent double, finished boolean").parquet(f"{at}/progress")


@query(f"""WITH RECURSIVE {NAMED_SQL} SELECT triage_category AS category, subject_id FROM named WHERE status = 'SUCCESS'
UNION ALL SELECT 'TRAIN_POOL', subject_id FROM named WHERE status = 'SUCCESS' AND triage_category <> 'NOISE_REJECT'""")
def p17_k06_committed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in files by category, told by one small manifest, read back from it."""
    at = folder(spark)
    manifests.commit(curate.split_rows(named_audit(spark, sf_dir)), at, {"CLEAN_DICE_MIN": rules.CLEAN_DICE_MIN}, rows_per_file=100)
    return manifests.read(spark, at)


@query("SELECT replace(p_brand, '#', '-') || '.txt' AS name, count(*) AS ids, sum(p_partkey) AS total FROM part GROUP BY p_brand")
def r07_settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder polled by a clock's trigger: a file of ids for each brand, each taken once it has stopped growing, read in tasks and put into a versioned table."""
    from ..sources import volumes
    from ..sources.versions import VersionedTable
    from ..streaming import monitor, settled

    at = folder(spark)
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.col("p_partkey").cast("string"))), "\n").alias("ids"))  # a file's own content
    rows = brands.select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".txt")).alias("path"), F.encode("ids", "UTF-8").alias("content"))
    there = volumes.exported(rows, f"{at}/in").agg(F.count("*")).first()[0]
    settled.register(spark)
    out = VersionedTable(spark, f"{at}/table", "name string, ids long, total long", "name", buckets=8)
    stream = spark.readStream.format("settledfiles").option("log", f"{at}/log").option("maxFiles", 10).load(f"{at}/in")
    ids = F.transform(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x.cast("long"))
    told = stream.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.size(ids).cast("long").alias("ids"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    running = monitor.upsert(told, out, f"{at}/checkpoint", every="200 milliseconds")
    try:
        while running.isActive and out.read().count() < there:
            running.awaitTermination(0.2)
        if running.exception():
            raise running.exception()
    finally:
        running.stop()
    return out.read()
