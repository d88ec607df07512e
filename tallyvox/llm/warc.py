"""Not-modified revisits of a web archive, resolved to the response they stand for.

An as-of join: each revisit goes with the latest earlier full response of its canonical URL. Captures are dealt out by ranges
of (URL, time), so a URL with very many captures is spread over tasks, however close together they are: inside a range a
window finds the latest response, and one row a range carries the latest of all earlier ranges forward. Then validators are
compared and permitted headers merged.

Rows with a null URL or time are returned as no_response. Of responses at the same time the one with the larger record id
counts; a response at a revisit's own time isn't earlier. Repeated revisits are each resolved; of an empty table nothing comes
out. Header names are lower-cased; of several that differ only in case the last in byte order counts (lower case after
upper). Columns other than those named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Headers that a not-modified answer doesn't change in the stored response: they describe its body or the connection.
KEPT_FROM_RESPONSE = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case, without scheme, www., default port, fragment, utm_ parameters and a last slash."""
    out = F.regexp_replace(url, "#.*$", "")
    out = F.regexp_replace(out, "^[A-Za-z]+://", "")
    host = F.lower(F.regexp_extract(out, "^[^/?]*", 0))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(out, "^[^/?]*(.*)$", 1), "utm_[a-z]+=[^&]*&?", ""), "[?&/]+$", "")
    return F.concat(F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", ""), rest)


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """A map with its keys in lower case; of equal ones the last in byte order counts. Null is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def resolve(records: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """The revisits of records(record_id long, url, ts long, status int, etag, last_modified, headers map), with canonical_url, outcome, response_id, response_ts and headers. ranges: how many ranges the captures are dealt to (Spark's choice by default).

    outcome: resolved (validators agree), mismatch, unverified (the revisit has no validator) or no_response. A revisit's
    headers are merged with the response's where resolved, and its own otherwise. Status 200 is a full response, 304 a revisit.
    """
    rows = records.select("record_id", "ts", "status", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    timed = rows.where("status in (200, 304) and canonical_url is not null and ts is not null")
    order = ["canonical_url", "ts", F.col("status") == 200, "record_id"]
    timed = written((timed.repartitionByRange(ranges, *order) if ranges else timed.repartitionByRange(*order)).withColumn("range", F.spark_partition_id()), "captures")
    # a map can't be compared, so the latest response is taken by position, not by max()
    inside = Window.partitionBy("canonical_url", "range").orderBy("ts", F.col("status") == 200, "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = timed.select("*", F.last(full, ignorenulls=True).over(inside).alias("here")).where("status = 304")
    key = F.struct("ts", "record_id")
    last = timed.where("status = 200").groupBy("canonical_url", "range").agg(F.max_by(F.struct("ts", "record_id", "etag", "last_modified", "headers"), key).alias("latest"))
    spots = found.select("canonical_url", "range").distinct()
    earlier = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(spots, ["canonical_url", "range"], "full").select("canonical_url", "range", F.last("latest", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    joined = found.join(carried, ["canonical_url", "range"], "left").withColumn("response", F.coalesce("here", "carried"))
    untimed = rows.where("status = 304 and (canonical_url is null or ts is null)")
    joined = joined.drop("here", "carried", "range").unionByName(untimed.withColumn("response", F.lit(None).cast(joined.schema["response"].dataType)))
    r = F.col("response")
    outcome = (
        F.when(r.isNull(), "no_response")
        .when(F.col("etag").isNull() & F.col("last_modified").isNull(), "unverified")
        .when(F.col("etag").isNotNull() & r["etag"].isNotNull(), F.when(_opaque(F.col("etag")) == _opaque(r["etag"]), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified") == r["last_modified"], "resolved")
        .otherwise("mismatch")
    )
    own, theirs = lower_names(F.col("headers")), lower_names(r["headers"])
    news = F.map_filter(own, lambda k, _: ~k.isin(*KEPT_FROM_RESPONSE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(news, k)), news)
    return joined.select("record_id", "canonical_url", "ts", outcome.alias("outcome"), r["record_id"].alias("response_id"), r["ts"].alias("response_ts"), own.alias("own"), merged.alias("merged")).select(
        "record_id", "canonical_url", "ts", "outcome", "response_id", "response_ts", F.when(F.col("outcome") == "resolved", F.col("merged")).otherwise(F.col("own")).alias("headers")
    )
