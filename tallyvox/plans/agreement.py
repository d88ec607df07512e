"""Queries of agreement metrics, consensus and triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import rules
from ..functions.metrics import Empty
from ..operators import agreement, ensemble, topology
from ..sources.cache import cached
from ..sources.shared import written
from . import views
from .registry import query
from .views import PLACED_SQL, PROBS_SQL, WIDE_SQL

R4 = lambda name: F.round(name, 4).alias(name)

CONFUSION_SQL = f"""{WIDE_SQL},
c AS (SELECT subject, organ, count(*) FILTER (l1 = organ AND l2 = organ) AS tp, count(*) FILTER (l1 <> organ AND l2 = organ) AS fp,
    count(*) FILTER (l1 = organ AND l2 <> organ) AS fn, count(*) FILTER (l1 <> organ AND l2 <> organ) AS tn
  FROM raters, (SELECT unnest([1, 2, 3, 4]) AS organ) GROUP BY subject, organ)"""


@query(f"""WITH {CONFUSION_SQL}
SELECT subject, organ, tp, fp, fn, tn,
  round(CASE WHEN tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 1e0 END, 4) AS dice,
  round(CASE WHEN tp + fp + fn > 0 THEN 1e0 * tp / (tp + fp + fn) ELSE 1e0 END, 4) AS iou,
  round(CASE WHEN tp + fp + fn = 0 THEN 1e0 WHEN tp + fp > 0 THEN 1e0 * tp / (tp + fp) ELSE 0e0 END, 4) AS precision,
  round(CASE WHEN tp + fp + fn = 0 THEN 1e0 WHEN tp + fn > 0 THEN 1e0 * tp / (tp + fn) ELSE 0e0 END, 4) AS sensitivity,
  round(CASE WHEN tn + fp > 0 THEN 1e0 * tn / (tn + fp) ELSE 1e0 END, 4) AS specificity FROM c""")
def m01_m06_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = agreement.confusion(views.pairs(spark, sf_dir), ["subject"])
    return agreement.overlap(counts).select("subject", "organ", "tp", "fp", "fn", "tn", R4("dice"), R4("iou"), R4("precision"), R4("sensitivity"), R4("specificity"))


@query(f"""WITH {CONFUSION_SQL}
SELECT subject, organ, round((tp + fn) * 45e-4, 4) AS ml_gt, round((tp + fp) * 45e-4, 4) AS ml_pred,
  round(1 - CASE WHEN tp + fp + fn > 0 THEN 1e0 * tp / (tp + fp + fn) ELSE 1e0 END, 4) AS voe,
  round(CASE WHEN tp + fp + fn = 0 THEN 0e0 WHEN tp + fn > 0 THEN 1e0 * (fp - fn) / (tp + fn) END, 4) AS rvd FROM c""")
def m07_m09_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = agreement.overlap(agreement.confusion(views.pairs(spark, sf_dir), ["subject"]))
    ml = lambda n, name: F.round(m.volume_ml(n, (1.5, 1.5, 2.0)), 4).alias(name)
    return c.select("subject", "organ", ml(F.col("tp") + F.col("fn"), "ml_gt"), ml(F.col("tp") + F.col("fp"), "ml_pred"), R4("voe"), R4("rvd"))


@query(f"""WITH {CONFUSION_SQL}
SELECT subject, organ, round(CASE WHEN tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 1e0 END, 4) AS dice_one,
  round(CASE WHEN tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) END, 4) AS dice_null,
  round(2 * tp / (2 * tp + fp + fn + 1e-6), 4) AS dice_smoothed FROM c""")
def m02_empty_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = agreement.confusion(views.pairs(spark, sf_dir), ["subject"])
    t = [F.col(x) for x in ("tp", "fp", "fn")]
    return c.select("subject", "organ", F.round(m.dice(*t), 4).alias("dice_one"), F.round(m.dice(*t, Empty.NULL), 4).alias("dice_null"), F.round(m.dice_smoothed(*t), 4).alias("dice_smoothed"))


@query(f"""WITH {WIDE_SQL}, n AS (SELECT subject, l2 AS label, count(*) AS n FROM raters GROUP BY ALL)
SELECT subject, label, n, round(100e0 * n / sum(n) OVER (PARTITION BY subject), 4) AS percent, CAST(count(*) OVER (PARTITION BY subject) AS BIGINT) AS labels FROM n""")
def m10_m11_label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = agreement.histogram(views.raters_wide(spark, sf_dir).select("subject", F.col("l2").alias("label")), ["subject"])
    return h.join(h.groupBy("subject").agg(F.count("*").alias("labels")), "subject").select("subject", "label", "n", R4("percent"), "labels")


PAIR_SQL = f"""{WIDE_SQL},
d AS (SELECT subject, unnest([
    {{'i': 0, 'j': 1, 'both': count(*) FILTER (l1 > 0 AND l2 > 0), 'total': count(*) FILTER (l1 > 0) + count(*) FILTER (l2 > 0)}},
    {{'i': 0, 'j': 2, 'both': count(*) FILTER (l1 > 0 AND l3 > 0), 'total': count(*) FILTER (l1 > 0) + count(*) FILTER (l3 > 0)}},
    {{'i': 1, 'j': 2, 'both': count(*) FILTER (l2 > 0 AND l3 > 0), 'total': count(*) FILTER (l2 > 0) + count(*) FILTER (l3 > 0)}}]) AS s
  FROM raters GROUP BY subject),
pd AS (SELECT subject, s.i AS i, s.j AS j, CASE WHEN s.total > 0 THEN 2e0 * s.both / s.total ELSE 1e0 END AS dice FROM d)"""


@query(f"WITH {PAIR_SQL} SELECT subject, i, j, round(dice, 4) AS dice FROM pd")
def m13_j04_pair_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ensemble.gathered(views.raters(spark, sf_dir), ["subject", "element"], views.RATERS)
    return ensemble.pair_dice(wide, ["subject"], 3).select("subject", "i", "j", R4("dice"))


WEIGHT_SQL = f"""{PAIR_SQL},
raw AS (SELECT subject, r, least(greatest(1 - sum(CASE WHEN i = r OR j = r THEN dice ELSE 0e0 END) / (2 + 1e-7), 5e-2), 1e0) AS div
  FROM pd, (SELECT unnest([0, 1, 2]) AS r) GROUP BY subject, r),
w AS (SELECT subject, r, div / sum(div) OVER (PARTITION BY subject) AS w FROM raw)"""


@query(f"WITH {WEIGHT_SQL} SELECT subject, r + 1 AS rater, round(w, 4) AS weight FROM w")
def m23_w07_diversity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ensemble.gathered(views.raters(spark, sf_dir), ["subject", "element"], views.RATERS)
    weights = ensemble.diversity_weights(ensemble.pair_dice(wide, ["subject"], 3), ["subject"], 3)
    return weights.select("subject", F.posexplode("weights").alias("pos", "w")).select("subject", (F.col("pos") + 1).alias("rater"), F.round("w", 4).alias("weight"))


CONSENSUS_SQL = f"""{WEIGHT_SQL},
ws AS (SELECT subject, max(w) FILTER (r = 0) AS w1, max(w) FILTER (r = 1) AS w2, max(w) FILTER (r = 2) AS w3 FROM w GROUP BY subject),
voted AS (SELECT subject, element, l1, l2, l3, list_transform([0, 1, 2, 3, 4], lambda c: CASE WHEN l1 = c THEN w1 ELSE 0e0 END + CASE WHEN l2 = c THEN w2 ELSE 0e0 END + CASE WHEN l3 = c THEN w3 ELSE 0e0 END) AS p FROM raters JOIN ws USING (subject)),
elements AS (SELECT *, list_position(list_transform(p, lambda x: round(x, 9)), list_max(list_transform(p, lambda x: round(x, 9)))) - 1 AS label,
  list_sum(list_transform(p, lambda x: -least(greatest(x, 1e-7), 1 - 1e-7) * log2(least(greatest(x, 1e-7), 1 - 1e-7)))) AS h FROM voted)"""


@query(f"WITH {CONSENSUS_SQL} SELECT subject, element, label, round(h, 4) AS h, round(p[1], 4) AS p0, round(p[2], 4) AS p1 FROM elements")
def m24_m28_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = ensemble.ensemble(views.raters(spark, sf_dir), views.RATERS)
    return elements.select("subject", "element", "label", R4("h"), F.round(F.col("p")[0], 4).alias("p0"), F.round(F.col("p")[1], 4).alias("p1"))


BETTI_SQL = f"""{CONSENSUS_SQL}, {PLACED_SQL},
mask AS (SELECT subject, rater, organ, n, x, y FROM (SELECT subject, element, unnest([0, 1, 2, 3]) AS rater, unnest([label, l1, l2, l3]) AS organ FROM elements) JOIN placed USING (subject, element) WHERE organ > 0),
face AS (SELECT a.subject, a.rater, a.organ, a.n AS low, b.n AS high FROM mask a JOIN mask b ON b.subject = a.subject AND b.rater = a.rater AND b.organ = a.organ AND b.n = a.n + 1 WHERE a.x < 7
  UNION ALL SELECT a.subject, a.rater, a.organ, a.n, b.n FROM mask a JOIN mask b ON b.subject = a.subject AND b.rater = a.rater AND b.organ = a.organ AND b.n = a.n + 8 WHERE a.y < 7
  UNION ALL SELECT a.subject, a.rater, a.organ, a.n, b.n FROM mask a JOIN mask b ON b.subject = a.subject AND b.rater = a.rater AND b.organ = a.organ AND b.n = a.n + 64),
edge AS (SELECT subject, rater, organ, low AS n, high AS other FROM face UNION ALL SELECT subject, rater, organ, high, low FROM face),
reach AS (SELECT subject, rater, organ, n, n AS root FROM mask UNION SELECT r.subject, r.rater, r.organ, e.other, r.root FROM reach r JOIN edge e ON e.subject = r.subject AND e.rater = r.rater AND e.organ = r.organ AND e.n = r.n WHERE e.other > r.root),
part AS (SELECT subject, rater, organ, n, min(root) AS root FROM reach GROUP BY ALL),
betti AS (SELECT subject, organ, {", ".join(f"count(DISTINCT root) FILTER (rater = {r}) AS b{r}" for r in range(4))} FROM part GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {BETTI_SQL} SELECT subject, organ, b0 AS consensus, b1, b2, b3, greatest(abs(b1 - b0), abs(b2 - b0), abs(b3 - b0)) AS worst FROM betti""")
def m14_m31_betti_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = topology.betti_differences(elements_in_place(spark, sf_dir), 3, list(rules.ORGANS))
    return d.select("subject", "organ", "consensus", *[F.col("raters")[r].alias(f"b{r + 1}") for r in range(3)], F.array_max("differences").alias("worst"))


def elements_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble's elements with their places."""
    wide = views.placed(spark, sf_dir)
    elements, _ = ensemble.ensemble(views.raters(spark, sf_dir), views.RATERS)
    return elements.join(wide.select("subject", "element", "x", "y", "z"), ["subject", "element"])


AUDIT_SQL = f"""{BETTI_SQL},
worst AS (SELECT subject, max(greatest(abs(b1 - b0), abs(b2 - b0), abs(b3 - b0))) AS worst FROM betti GROUP BY subject),
long AS (SELECT subject, element, label, l1, l2, l3, h, organ FROM elements, (SELECT unnest([1, 2, 3, 4]) AS organ)),
each AS (SELECT subject, organ,
    avg(h) AS mean_h, max(h) AS max_h,
    [{", ".join(f"CASE WHEN count(*) FILTER (l{r} = organ) + count(*) FILTER (label = organ) > 0 THEN 2e0 * count(*) FILTER (l{r} = organ AND label = organ) / (count(*) FILTER (l{r} = organ) + count(*) FILTER (label = organ)) ELSE 1e0 END" for r in (1, 2, 3))}] AS dice,
    [{", ".join(f"CASE WHEN count(*) FILTER (l{r} = organ OR label = organ) > 0 THEN 1e0 * count(*) FILTER (l{r} = organ AND label = organ) / count(*) FILTER (l{r} = organ OR label = organ) ELSE 1e0 END" for r in (1, 2, 3))}] AS iou,
    [{", ".join(f"CASE WHEN count(*) FILTER (l{a} = organ) + count(*) FILTER (l{b} = organ) > 0 THEN 2e0 * count(*) FILTER (l{a} = organ AND l{b} = organ) / (count(*) FILTER (l{a} = organ) + count(*) FILTER (l{b} = organ)) ELSE 1e0 END" for a, b in ((1, 2), (1, 3), (2, 3)))}] AS inter
  FROM long GROUP BY subject, organ),
audit AS (SELECT subject, round(avg(list_avg(dice)), 4) AS mean_consensus_dice, round(avg(list_avg(iou)), 4) AS mean_consensus_iou, round(avg(list_avg(inter)), 4) AS mean_inter_model_dice,
    coalesce(max(worst), 0) AS max_betti_diff, round(max(mean_h), 4) AS mean_uncertainty, round(max(max_h), 4) AS max_uncertainty
  FROM each LEFT JOIN worst USING (subject) GROUP BY subject),
triaged AS (SELECT *, CASE WHEN max_betti_diff > 5 OR mean_consensus_dice < 5e-1 OR mean_uncertainty > 15e-2 THEN 'NOISE_REJECT'
    WHEN mean_consensus_dice >= 82e-2 AND mean_inter_model_dice >= 85e-2 AND max_betti_diff <= 2 THEN 'CLEAN_HIGH_CONFIDENCE' ELSE 'WEAK_COARSE' END AS triage_category FROM audit)"""
ACTION_SQL = "CASE triage_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ACTIONS.items()) + " END"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table with category and action, made once for the file it's made from."""

    def make() -> DataFrame:
        elements = written(elements_in_place(spark, sf_dir))
        found = ensemble.audit(elements, topology.betti_differences(elements, 3, list(rules.ORGANS)), 3)
        category = rules.triage(*(F.col(c) for c in ("mean_consensus_dice", "mean_inter_model_dice", "max_betti_diff", "mean_uncertainty")))
        return found.withColumn("triage_category", category).withColumn("action", rules.action(F.col("triage_category")))

    return cached(spark, "audit", [f"{sf_dir}/events.parquet"], make)


@query(f"WITH RECURSIVE {AUDIT_SQL} SELECT *, {ACTION_SQL} AS action FROM triaged")
def p01_p02_m29_m33_triage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir)


@query(f"WITH RECURSIVE {AUDIT_SQL}, n AS (SELECT triage_category, count(*) AS n FROM triaged GROUP BY ALL) SELECT triage_category, n, round(100e0 * n / sum(n) OVER (), 2) AS percent FROM n")
def m38_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import value_counts

    return value_counts(audit(spark, sf_dir), "triage_category")


@query(f"""WITH {WIDE_SQL}, c AS (SELECT subject, l1 AS gt, l2 AS pred, count(*)::DOUBLE AS n FROM raters GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY subject, gt) AS a, sum(n) OVER (PARTITION BY subject, pred) AS b FROM c),
s AS (SELECT subject, sum(n) AS t, sum(n * n) - sum(n) AS tp, sum(n * a) - sum(n * n) AS fn, sum(n * b) - sum(n * n) AS fp, sum(n) * sum(n) - sum(n * a) - sum(n * b) + sum(n * n) AS tn, -sum(n * (log2(n / a) + log2(n / b))) AS h FROM m GROUP BY subject)
SELECT subject, round(CASE WHEN fn = 0 AND fp = 0 THEN 1e0 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 4) AS ari, round(h / t, 4) AS voi FROM s""")
def m19_m20_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.clustering(views.pairs(spark, sf_dir), ["subject"]).select("subject", R4("ari"), R4("voi"))


@query(f"""WITH {WIDE_SQL}, c AS (SELECT l1 AS gt, l3 AS pred, count(*)::DOUBLE AS n FROM raters WHERE element % 50 = 0 GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY gt) AS a, sum(n) OVER (PARTITION BY pred) AS b FROM c)
SELECT round(-sum(n * (log2(n / a) + log2(n / b))) / sum(n), 4) AS voi, CAST(sum(n) AS BIGINT) AS sampled FROM m""")
def w01_sampled_voi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agreement.sampled(views.pairs(spark, sf_dir, 1, 3), F.col("element")).withColumn("all", F.lit(1))
    return agreement.clustering(rows, ["all"]).join(rows.groupBy("all").agg(F.count("*").alias("sampled")), "all").select(R4("voi"), "sampled")


@query(f"""WITH {PROBS_SQL}, top AS (SELECT element, truth, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred FROM probs)
SELECT element, truth, pred, round(conf, 4) AS conf FROM top""")
def m22_n10_top_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.probabilities(spark, sf_dir).select("element", "truth", rules.top_class(F.col("p")).alias("pred"), F.round(F.array_max("p"), 4).alias("conf"))


@query(f"""WITH {PROBS_SQL}, top AS (SELECT truth, list_max(p) AS conf, list_position(p, list_max(p)) - 1 AS pred FROM probs),
edges AS (SELECT range AS b, range * 1e-1 AS lo, CASE WHEN range = 9 THEN 1e0 ELSE (range + 1) * 1e-1 END AS hi FROM range(10)),
bins AS (SELECT b, count(*) AS k, avg(CAST(pred = truth AS INTEGER)::DOUBLE) AS acc, avg(conf) AS mean FROM top LEFT JOIN edges ON conf > lo AND conf <= hi GROUP BY b)
SELECT round(sum(CASE WHEN b IS NULL THEN 0 ELSE abs(acc - mean) * k END) / sum(k), 4) AS ece FROM bins""")
def m21_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.probabilities(spark, sf_dir).select("truth", F.array_max("p").alias("conf"), rules.top_class(F.col("p")).alias("pred"), F.lit(1).alias("all"))
    return agreement.calibration_error(p, ["all"]).select(R4("ece"))


@query(f"""WITH {PROBS_SQL}, e AS (SELECT element, p, list_transform(p, lambda x: least(greatest(x, 1e-7), 1 - 1e-7)) AS q, least(greatest(p[1], 1e-7), 1 - 1e-7) AS b FROM probs)
SELECT element, round(list_sum(list_transform(q, lambda x: -x * log2(x))), 4) AS h, round(-b * log2(b) - (1 - b) * log2(1 - b), 4) AS h_binary FROM e""")
def m27_m28_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.probabilities(spark, sf_dir).select("element", F.round(rules.entropy(F.col("p")), 4).alias("h"), F.round(rules.entropy(F.slice("p", 1, 1)), 4).alias("h_binary"))


@query(f"""WITH {PROBS_SQL}, s AS (SELECT truth, element % 3 AS sample, element // 3 AS item, unnest(p) AS p, generate_subscripts(p, 1) AS cls FROM probs),
v AS (SELECT truth, item, cls, var_pop(p) AS v FROM s GROUP BY ALL), i AS (SELECT truth, item, avg(v) AS v FROM v GROUP BY ALL)
SELECT truth, round(avg(v), 6) AS variance FROM i GROUP BY truth""")
def m30_dropout_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.probabilities(spark, sf_dir).select("truth", F.expr("element div 3").alias("item"), F.posexplode("p").alias("cls", "p"))
    return ensemble.dropout_variance(s, ["truth"], ["item"]).select("truth", F.round("variance", 6).alias("variance"))


@query(f"""WITH {CONFUSION_SQL}, d AS (SELECT subject, organ, CASE WHEN tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 1e0 END AS dice, CASE WHEN fn % 5 = 0 THEN NULL ELSE fn * 25e-1 END AS hd FROM c)
SELECT subject, organ, round(4e-1 * dice + 6e-1 * coalesce(greatest(0e0, 1 - hd / 50), 0e0), 4) AS composite FROM d""")
def p05_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = agreement.overlap(agreement.confusion(views.pairs(spark, sf_dir), ["subject"]))
    hd = F.when(F.col("fn") % 5 != 0, F.col("fn") * 2.5)
    return c.select("subject", "organ", F.round(rules.composite(F.col("dice"), hd), 4).alias("composite"))


@query(f"""WITH {WIDE_SQL}, a AS (SELECT subject, CASE WHEN l1 > 0 AND l1 <> l2 THEN 255 ELSE l1 END AS out, l1 FROM raters),
n AS (SELECT subject, count(*) FILTER (l1 > 0) AS n_foreground, count(*) FILTER (out = 255) AS n_ignore FROM a GROUP BY subject)
SELECT subject, n_foreground, n_ignore, round(CASE WHEN n_foreground > 0 THEN 100e0 * n_ignore / n_foreground ELSE 0e0 END, 2) AS pct_ignore FROM n""")
def m12_p14_autolabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.curate import autolabel_stats

    return autolabel_stats(views.pairs(spark, sf_dir), ["subject"])
