"""How far the sources of a language differ in their words: integer chi-square divergences of all pairs, and each source's own terms.

A term's share in a group is p = 1 + floor(SCALE * (count + 1) / (N + V)): N is the group's count of kept terms, V their number. A
pair's value is the sum over all V terms of f(p, q) = floor((p - q)^2 / q), p of the one group and q of the other. Most terms are in
few groups, so the sum is taken apart by support: with p0 and q0 the shares of a count of 0,

    sum over the one group's terms of f(p, q0)     from its histogram of counts: equal counts have equal shares
  + sum over the other group's terms of f(p0, q)   likewise
  + (V - terms in the one - terms in the other + terms in both) * f(p0, q0)
  + sum over the terms in both of f(p, q) - f(p, q0) - f(p0, q)   from the join of postings on the term

so only terms that both have are ever met one by one, and absent ones cost nothing. Pairs are joined one way round, and each row
of the join counts for both directions; sums are taken in the tasks first. All numbers are integers: the division goes digit
group by digit group, so SCALE * count needn't fit in 64 bits; sums stay below 2^63 while V is below 2^31 and N below 2^52.

Null text, lang and source are ''. Each row counts as a document, also where it is repeated. Groups without terms take part with
counts of 0. Equal values are ranked by the item's bytes. Very long texts and terms are counted whole; of an empty table nothing
comes out. Other columns aren't read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .periodic import spelled
from .scratch import written

#: Terms are runs of ASCII letters and of whatever isn't ASCII.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SCALE, PLUS, DOCUMENTS, TOP = 1_000_000_000, 1, 3, 200
GROUP = ["lang", "source"]
#: Groups are sent to all tasks up to so many, some 64 MB.
SENT_GROUPS = 1 << 19


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text): occurrences and documents of each term, in part sums; a row with a null term for each group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, size=4 * tx.CHUNK):
            low = chunk.lower()
            starts, ends, at = low.words(LETTERS)
            coded = spelled(low, starts, ends).dictionary_encode()
            number, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            lang, source = (tx.column(chunk.rows, c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in GROUP)
            _, first, group = np.unique(lang * chunk.n + source, return_index=True, return_inverse=True)
            doc = np.repeat(np.arange(chunk.n), np.diff(at))
            key = (group[doc] * max(1, len(names)) + number) * chunk.n + doc
            each, n = np.unique(key, return_counts=True)  # in order of group, term and document
            pair = each // max(1, chunk.n)
            begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            of, term = first[pair[begin] // max(1, len(names))], pair[begin] % max(1, len(names))
            rows = pa.array(np.concatenate([of, first]))
            yield tx.batch(
                lang=tx.column(chunk.rows, "lang").take(rows), source=tx.column(chunk.rows, "source").take(rows), term=pa.concat_arrays([names.take(pa.array(term)), pa.nulls(len(first), pa.string())]),
                n=np.concatenate([np.add.reduceat(n, begin) if len(begin) else n, np.zeros(len(first), np.int64)]), docs=np.concatenate([np.diff(np.append(begin, len(pair))), np.zeros(len(first), np.int64)]),
            )

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + PLUS) / total), three decimal digits at a time."""
    left, out = count + F.lit(PLUS).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        out, left = out * 1000 + div(left * 1000, total), (left * 1000) % total
    return out + 1


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


class Audit:
    """Of docs, written: kept (lang, source, term, c, p, lp: postings with the group's share and the language's) and groups (lang, source, id, v, total, terms, p0)."""

    def __init__(self, docs: DataFrame, *, documents: int = DOCUMENTS, text: str = "text", lang: str = "lang", source: str = "source"):
        rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text))])
        counts = written(term_counts(rows).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
        every = Window.partitionBy("lang", "term")  # as many rows as sources have the term
        kept = counts.where("term is not null").withColumns({"all": F.sum("n").over(every), "docs": F.sum("docs").over(every), "nth": F.row_number().over(every.orderBy("source"))}).where(F.col("docs") >= documents)
        kept = written(kept.select(*GROUP, "term", F.col("n").alias("c"), "all", (F.col("nth") == 1).alias("first")), "kept")
        langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("l_total"))
        sums = kept.groupBy(*GROUP).agg(F.count("*").alias("terms"), F.sum("c").alias("n"))
        groups = counts.where("term is null").select(*GROUP).join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["terms", "n", "v", "l_total"])
        total = F.col("n") + F.col("v") * PLUS
        ids = Window.partitionBy("lang").orderBy("source")  # numbers in place of names, in the join of postings
        groups = groups.select(*GROUP, F.row_number().over(ids).alias("id"), "v", "terms", total.alias("total"), (F.col("l_total") + F.col("v") * PLUS).alias("l_total"))
        self.groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total")))), "groups")
        self.few = self.groups.count() <= SENT_GROUPS
        of = self.sent(self.groups.select(*GROUP, "id", "total", "l_total", "p0"))
        self.kept = written(kept.join(of, GROUP).select("lang", "source", "id", "term", "c", "p0", share(F.col("c"), F.col("total")).alias("p"), share(F.col("all"), F.col("l_total")).alias("lp")), "shares")

    def sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def one_sided(self) -> DataFrame:
        """(lang, a, b, own, other): sums of f(p, q0) over the terms of group a, as if b had none of them, and of f(q0, p), the other way round."""
        histogram = self.kept.groupBy("lang", "id", "p").agg(F.count("*").alias("m"))
        others = self.sent(self.groups.select("lang", F.col("id").alias("b"), F.col("p0").alias("q0")))
        met = histogram.join(others, "lang").where("id <> b")
        return met.groupBy("lang", F.col("id").alias("a"), "b").agg(F.sum(F.col("m") * apart(F.col("p"), F.col("q0"))).alias("own"), F.sum(F.col("m") * apart(F.col("q0"), F.col("p"))).alias("other"))

    def overlaps(self) -> DataFrame:
        """(lang, a, b, both, change): of each two groups that share terms, their number and what they change in the sums of one_sided() for p of a and q of b."""
        one = self.kept.select("lang", "term", F.col("id").alias("a"), "p", "p0")
        two = self.kept.select("lang", "term", F.col("id").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
        met = one.join(two, ["lang", "term"]).where("a < b")
        p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
        sums = met.groupBy("lang", "a", "b").agg(
            F.count("*").alias("both"), F.sum(apart(p, q) - apart(p, q0) - apart(p0, q)).alias("change"), F.sum(apart(q, p) - apart(q0, p) - apart(q, p0)).alias("back")
        )
        return sums.select("lang", F.explode(F.array(F.struct("a", "b", "both", "change"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "both", F.col("back").alias("change")))).alias("x")).select("lang", "x.*")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the divergence of each source from each other one of its language."""
        side = ["id", "source", "terms", "p0"]
        one = self.groups.select("lang", "v", *[F.col(c).alias(f"a_{c}") for c in side])
        two = self.groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in side])
        every = one.join(self.sent(two), "lang").where("a_id <> b_id")
        single = self.one_sided()
        mine = single.select("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "own")
        theirs = single.select("lang", F.col("b").alias("a_id"), F.col("a").alias("b_id"), "other")
        both = self.overlaps().select("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "both", "change")
        key = ["lang", "a_id", "b_id"]
        rows = every.join(mine, key, "left").join(theirs, key, "left").join(both, key, "left").na.fill(0, ["own", "other", "both", "change"])
        absent = (F.col("v") - F.col("a_terms") - F.col("b_terms") + F.col("both")) * apart(F.col("a_p0"), F.col("b_p0"))
        return rows.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.when(F.col("v") > 0, F.col("own") + F.col("other") + absent + F.col("change")).otherwise(0).cast("long").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): a source's terms that are above their share in the language, the first `top` of each."""
        found = self.kept.where("p > lp").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("lp")).alias("value"))
        return ranked(found).where(F.col("rank") <= top)  # a task sends on its own first ones only


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, *, top: int = TOP, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the source's own terms."""
    found = Audit(docs, **options)
    columns = [*GROUP, "part", "item", "value", "rank"]
    return ranked(found.pairs()).withColumn("part", F.lit("pair")).select(columns).unionByName(found.terms(top).withColumn("part", F.lit("term")).select(columns))
