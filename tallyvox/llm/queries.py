"""One query for each numbered operator, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score", "probability")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text: of good quality and not toxic."""
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("target"))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import select

    sampled, _ = select(table(spark, sf_dir, "documents"), targets(spark, sf_dir))
    return sampled.select("doc_id", F.round("log_weight", 9).alias("log_weight"), "key", F.lit(True).alias("kept"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages: each is fetched at 8 * page_id, and asked for again with its tag, with another tag or with its date only, also before the fetch."""
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")), "yyyy-MM-dd HH:mm:ss")
    tag = F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    page = pages.select("page_id", "url", tag.alias("tag"), date.alias("date"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    none = F.lit(None).cast("string")

    def record(nth: int, status: int, shift: int, etag, modified, headers):
        return F.struct((F.col("page_id") * 4 + nth).alias("record_id"), (F.col("page_id") * 8 + shift).alias("ts"), F.lit(status).alias("status"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))

    fetched = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Age"), (F.col("page_id") % 7).cast("string"))
    log = F.array(
        record(0, 200, 0, F.col("tag"), F.col("date"), fetched),
        record(1, 304, 3, F.concat(F.lit("W/"), F.col("tag")), none, again),
        record(2, 304, 5, F.when(F.col("page_id") % 5 == 0, F.lit("other")), F.col("date"), again),
        record(3, 304, -1, none, F.when(F.col("page_id") % 3 > 0, F.col("date")), again),
    )
    return page.select("url", F.explode(log).alias("r")).select("url", "r.*")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import resolve

    found = resolve(captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", F.expr("record_id div 4").alias("page_id"), "canonical_url", "outcome", "response_id", listed.alias("headers"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    stored = repair.write(table(spark, sf_dir, "documents"), tokenizer_file())
    return repair.read(stored).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import eflm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", eflm.held_out(F.col("doc_id")).alias("held_out"))
    docs = docs.withColumn("training", ~F.col("held_out"))
    return eflm.score(eflm.train(docs, keep=("doc_id", "held_out"), training="training"), keep=("doc_id", "held_out"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import report

    return report(table(spark, sf_dir, "documents"))


def tail_repeated(doc_id: int | None, n: int):
    """The words of every tenth document by its id's checksum: from some word on, a stretch of them again and again."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find

    found = find(table(spark, sf_dir, "documents"), order=tail_repeated)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))  # runs are by start and period, so the first of equals stays
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP5_SQL = """
WITH page AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
    length(coalesce(html, '')) AS size, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') AS u
  FROM pages),
canon AS (
  SELECT page_id, tag, date, size,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), 'utm_[a-z]+=[^&]*&?', '', 'g'), '[?&/]+$', '') AS canonical_url
  FROM page),
asked AS (
  SELECT 4 * page_id + 1 AS record_id, page_id, 8 * page_id + 3 AS ts, canonical_url, tag AS etag, NULL AS modified FROM canon
  UNION ALL SELECT 4 * page_id + 2, page_id, 8 * page_id + 5, canonical_url, CASE WHEN page_id % 5 = 0 THEN 'other' END, date FROM canon
  UNION ALL SELECT 4 * page_id + 3, page_id, 8 * page_id - 1, canonical_url, NULL, CASE WHEN page_id % 3 > 0 THEN date END FROM canon),
found AS (
  SELECT a.*, r.page_id AS of, r.tag AS r_tag, r.date AS r_date, r.size AS r_size
  FROM asked a ASOF LEFT JOIN (SELECT *, 8 * page_id AS r_ts FROM canon) r ON a.canonical_url = r.canonical_url AND a.ts > r.r_ts),
judged AS (
  SELECT *, CASE WHEN of IS NULL THEN 'no_response' WHEN etag IS NULL AND modified IS NULL THEN 'unverified'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = r_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified = r_date THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM found)
SELECT record_id, page_id, canonical_url, outcome, 4 * of AS response_id,
  'age=' || (page_id % 7) || ';cache-control=max-age=600;content-length=' || CASE WHEN outcome = 'resolved' THEN r_size || ';content-type=text/html' ELSE '0' END AS headers
FROM judged
"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS t FROM (SELECT *, least(len(w), 10) AS k FROM i WHERE len(w) > 0)),
windows AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k),
found AS (SELECT doc_id, v.k, v.p, m.item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS t FROM windows) v JOIN item_windows m ON m.k = v.k AND m.t = v.t),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(named.names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""
OP12_SQL = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS d, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
lines AS (SELECT doc_id, d, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS line FROM split),
keyed AS (SELECT *, {LOWER_SQL.replace("coalesce(text, '')", "regexp_replace(line, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g')")} AS k FROM lines),
hot AS (SELECT k FROM (SELECT DISTINCT d, k FROM keyed WHERE k <> '') GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON hot.k = keyed.k GROUP BY doc_id, d
"""
OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d, regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, d, unnest(w) AS term FROM d),
voc AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
cnt AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN voc v ON v.lang = o.lang AND v.term = o.term GROUP BY ALL),
lang_n AS (SELECT lang, count(*) AS v, sum(c) AS n FROM voc GROUP BY lang),
grp_n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
full_p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000 * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + l.v) AS HUGEINT) AS p, CAST(1 + 1000000000 * (v.c + 1) // (l.n + l.v) AS HUGEINT) AS lp
  FROM grp g JOIN voc v ON v.lang = g.lang JOIN lang_n l ON l.lang = g.lang LEFT JOIN grp_n n ON n.lang = g.lang AND n.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
val AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM full_p a JOIN full_p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(val.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN val ON val.lang = a.lang AND val.source = a.source AND val.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - lp) * (p - lp) // lp AS BIGINT) FROM full_p WHERE c > 0 AND p > lp),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op5_revisits": OP5_SQL, "op6_decontamination": OP6_SQL, "op12_line_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
