"""URL filter: host and path rules, then a ratio of two character models. DataFrame functions only.

The models are Markov chains of variable order over characters, one for accepted and one for rejected URLs. A context of three
characters is used where the training URLs have it often enough, else that of the last two; contexts of two, one and no
character are interpolated by the number of different characters that follow them (Witten-Bell), and those of three with
what the last two say. A URL's score is ln P(accepted) - ln P(rejected) over its characters, divided by their number. On URLs
that the models haven't seen, a logistic curve turns scores into probabilities (Platt scaling); a URL is accepted from a
probability of a half. Characters are folded to 32 classes, and contexts of three have a share of all characters at least, so
the models are two arrays of bounded size whatever the corpus; scoring reads them without a join or shuffle.

Null and empty URLs have no characters: score and probability null, accepted. Where one class has no labelled URL all scores are
0; where one has none held out the threshold is 0 and the curve that of the difference itself; a score at the threshold is
accepted. Very long URLs are scored whole. Repeated rows are judged alike, each on its own. Of an empty table nothing comes out.
Columns of pages with the names of those added are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Of the fold of characters: 1 to 30 by their place here, other characters 31, before the text 0. Digits are one class.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/"
SIZE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts with these strings are the rejected examples where no labels are given.
REJECT_SEEDS = ("adult", "casino", "pills", "spam", "ads-")
#: One in so many URLs, by a hash, calibrates; the others train.
HELD_OUT = 5
#: Scores are counted for calibration in steps of GRID up to REACH.
GRID, REACH = 0.05, 8.0
#: A context of three characters is used where it is seen LEAST_SEEN times, and one in CONTEXTS of all; so there are no more than CONTEXTS.
LEAST_SEEN, CONTEXTS = 16, 1024


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; both null where none does. The rules are a parameter, not data."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def grams(url: Column) -> Column:
    """For each character, the number of it and the three before it in base 32."""
    folded = F.translate(F.lower(F.when(F.instr(url, "://") > 0, after_scheme(url)).otherwise(url)), "123456789", "000000000")
    letters = F.filter(F.split(folded, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE - 1)))
    first = lambda extra: F.slice(F.concat(F.array(*[F.lit(0)] * extra), codes), F.lit(1), F.size(letters))
    two = lambda x, y: F.zip_with(x, y, lambda a, b: a * SIZE + b)
    return two(two(two(first(3), first(2)), first(1)), codes)


def counted(labelled: DataFrame) -> DataFrame:
    """(accepted, g, n) of labelled (grams, accepted): at most 2 * 32**4 rows."""
    return labelled.select("accepted", F.explode("grams").alias("g")).groupBy("accepted", "g").agg(F.count("*").alias("n"))


def second_order(counts: DataFrame) -> DataFrame:
    """(accepted, bcd, p) for all 32**3 characters d after two others b, c, null where a class has no text. Every table here has at most 2 * 32**3 rows."""
    by3 = counts.groupBy("accepted", F.expr(f"g % {SIZE**3}").alias("bcd")).agg(F.sum("n").alias("n3"))
    by2 = by3.groupBy("accepted", F.expr(f"bcd % {SIZE**2}").alias("cd")).agg(F.sum("n3").alias("n2"))
    by1 = by2.groupBy("accepted", F.expr(f"cd % {SIZE}").alias("d")).agg(F.sum("n2").alias("n1"))
    from3 = by3.groupBy("accepted", F.expr(f"bcd div {SIZE}").alias("bc")).agg(F.sum("n3").alias("s3"), F.count("*").alias("t3"))
    from2 = by2.groupBy("accepted", F.expr(f"cd div {SIZE}").alias("c")).agg(F.sum("n2").alias("s2"), F.count("*").alias("t2"))
    from1 = by1.groupBy("accepted").agg(F.sum("n1").alias("s1"), F.count("*").alias("t1"))
    grid = counts.sparkSession.range(2 * SIZE**3, numPartitions=2).select((F.col("id") >= SIZE**3).alias("accepted"), (F.col("id") % SIZE**3).alias("bcd"))
    grid = grid.selectExpr("accepted", "bcd", f"bcd % {SIZE**2} as cd", f"bcd % {SIZE} as d", f"bcd div {SIZE} as bc", f"bcd div {SIZE} % {SIZE} as c")
    for small, on in ((by3, "bcd"), (by2, "cd"), (by1, "d"), (from3, "bc"), (from2, "c")):
        grid = grid.join(F.broadcast(small), ["accepted", on], "left")
    grid = grid.join(F.broadcast(from1), "accepted", "left").na.fill(0)
    p1 = (F.col("n1") + F.col("t1") / SIZE) / F.nullif(F.col("s1") + F.col("t1"), F.lit(0))
    p2 = F.when(F.col("t2") > 0, (F.col("n2") + F.col("t2") * p1) / (F.col("s2") + F.col("t2"))).otherwise(p1)
    p3 = F.when(F.col("t3") > 0, (F.col("n3") + F.col("t3") * p2) / (F.col("s3") + F.col("t3"))).otherwise(p2)
    return grid.select("accepted", "bcd", p3.alias("p"))


def third_order(counts: DataFrame, second: DataFrame) -> DataFrame:
    """(accepted, abc, d, p) for the contexts of three characters in use: at most 2 * 32 * CONTEXTS rows."""
    by = counts.groupBy(F.expr(f"g div {SIZE}").alias("abc"), "accepted").agg(F.sum("n").alias("s4"), F.count("*").alias("t4"))
    bar = counts.agg(F.greatest(F.lit(LEAST_SEEN), F.sum("n") / CONTEXTS).alias("bar"))
    used = by.groupBy("abc").agg(F.sum("s4").alias("s")).where(F.col("s") >= bar.scalar()).select("abc")
    grid = used.select("abc", F.explode(F.array(F.lit(False), F.lit(True))).alias("accepted")).select("abc", "accepted", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("d"))
    grid = grid.withColumns({"g": F.col("abc") * SIZE + F.col("d"), "bcd": F.expr(f"abc % {SIZE**2} * {SIZE} + d")})
    grid = grid.join(F.broadcast(second), ["accepted", "bcd"]).join(by, ["accepted", "abc"], "left").join(counts, ["accepted", "g"], "left").na.fill(0, ["s4", "t4", "n"])
    p = F.when(F.col("t4") > 0, (F.col("n") + F.col("t4") * F.col("p")) / (F.col("s4") + F.col("t4"))).otherwise(F.col("p"))
    return grid.select("accepted", "abc", "d", p.alias("p"))


def difference(p: DataFrame, by: list[str]) -> DataFrame:
    """(by, w): ln P(accepted) - ln P(rejected), 0 where a class has no text."""
    each = p.groupBy(*by).agg(F.sum(F.when(F.col("accepted"), F.log("p")).otherwise(-F.log("p"))).alias("w"), F.count("p").alias("models"))
    return each.select(*by, F.when(F.col("models") == 2, F.col("w")).otherwise(F.lit(0.0)).alias("w"))


class Model:
    """`weights` has a row of SIZE numbers for each context b, c of two characters, in order, then one for each a, b, c in use; slots[abc] is that one's number from 1, or 0. Both are constants of the plan, as columns they would be copied with each row."""

    def __init__(self, labelled: DataFrame):
        counts = written(counted(labelled), "url-counts")  # small tables that are read several times
        second = written(second_order(counts), "url-grid")
        row = lambda df, by: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, "w"))), lambda x: x["w"]).alias("w")).first()["w"]
        base = row(difference(second, ["bcd"]), ["bcd"])
        third = difference(third_order(counts, second), ["abc", "d"]).groupBy("abc").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda x: x["w"]).alias("w"))
        rows = sorted(((r["abc"], r["w"]) for r in third.collect()), key=lambda r: r[0])  # at most CONTEXTS
        self.slots, self.weights = [0] * SIZE**3, list(base)
        for nth, (abc, w) in enumerate(rows, 1):
            self.slots[abc] = nth
            self.weights += w

    def scored(self, df: DataFrame, into: str = "score") -> DataFrame:
        """df (with grams) and each row's score: null without characters."""
        slots = F.split(F.lit(",".join(map(str, self.slots))), ",").cast("array<int>")
        weights = F.split(F.lit(",".join(f"{x:.5g}" for x in self.weights)), ",").cast("array<double>")
        # the row of abc is SIZE ** 2 + slot - 1, else that of bc
        row = lambda slot, g: F.when(slot > 0, slot + (SIZE**2 - 1)).otherwise(F.shiftright(g, 5).bitwiseAND(SIZE**2 - 1))
        total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(weights, row(F.get(slots, F.shiftright(g, 5)), g) * SIZE + g.bitwiseAND(SIZE - 1)))
        return df.withColumn(into, F.when(F.size("grams") > 0, total / F.size("grams")))


def calibrated(held_out: DataFrame) -> tuple[float, float]:
    """(slope, offset): sigmoid(slope * score + offset) is the probability of acceptance. held_out: (score, accepted), counted in bins of a fixed grid, which are all that the driver sees."""
    slot = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.round(F.col("score") / GRID) * GRID))
    bins = held_out.where("score is not null").groupBy(F.round(slot, 6).alias("at")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).collect()
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return 1.0, 0.0
    high, low = (good + 1) / (good + 2), 1 / (bad + 2)  # Platt's targets
    slope, offset = 1.0, 0.0
    loss = lambda a, b: sum(x["good"] * bent(high, a * x["at"] + b) + x["bad"] * bent(low, a * x["at"] + b) for x in bins)
    for _ in range(100):  # Newton's method, halving steps that don't help
        g0 = g1 = h00 = h01 = h11 = 0.0
        for b in sorted(bins, key=lambda b: b["at"]):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * b["at"] + offset))))
            n, error = b["good"] + b["bad"], (b["good"] + b["bad"]) * p - b["good"] * high - b["bad"] * low
            v = n * max(p * (1 - p), 1e-12)
            g0, g1, h00, h01, h11 = g0 + error * b["at"], g1 + error, h00 + v * b["at"] ** 2, h01 + v * b["at"], h11 + v
        det = (h00 + 1e-9) * (h11 + 1e-9) - h01 * h01
        step = ((h11 + 1e-9) * g0 - h01 * g1) / det, ((h00 + 1e-9) * g1 - h01 * g0) / det
        size = 1.0
        while size > 1e-9 and loss(slope - size * step[0], offset - size * step[1]) > loss(slope, offset):
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if abs(g0) + abs(g1) < 1e-9 * (good + bad):
            break
    return (slope, offset) if slope > 0 else (1.0, 0.0)


def bent(target: float, x: float) -> float:
    """Cross entropy of a target with sigmoid(x)."""
    return max(x, 0.0) - target * x + math.log1p(math.exp(-abs(x)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url", labels: Column | None = None) -> DataFrame:
    """pages with host, path, rule, score, probability, threshold and verdict (columns of pages with these names are replaced). labels: whether a row is an accepted example (true), a rejected one (false) or none (null); by default rejected where the host has a seed string."""
    host = host_of(F.col(url))
    if labels is None:
        seen = F.lit(False)
        for seed in REJECT_SEEDS:
            seen = seen | F.contains(host, F.lit(seed))
        labels = ~seen
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "probability", "threshold", "verdict", "grams", "_accepted")]
    df = pages.select(*kept, host.alias("host"), path_of(F.col(url)).alias("path"), grams(F.col(url)).alias("grams"), labels.alias("_accepted"))
    labelled = df.where("_accepted is not null").select("grams", F.col("_accepted").alias("accepted"))
    aside = F.xxhash64("grams") % HELD_OUT == 0
    model = Model(labelled.where(~aside))
    slope, offset = calibrated(model.scored(labelled.where(aside)))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    out = model.scored(df).withColumn("probability", 1 / (1 + F.exp(-(slope * F.col("score") + offset)))).withColumn("threshold", F.lit(-offset / slope))
    method = F.when(F.col("score") < F.col("threshold"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*kept, "host", "path", rule.alias("rule"), "score", "probability", "threshold", F.coalesce(said, method).alias("verdict"))
