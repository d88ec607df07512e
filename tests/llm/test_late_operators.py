"""Runs of words, lines and divergences of sources against brute force, and on odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import divergence, line_dedup, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11


def runs_of(w, times=4, least=6):
    """Stretches by comparing all words p apart, each with the smallest of its periods, told by its borders."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    for (start, length), p in found.items():
        part = w[start : start + length]
        assert not any(part[q:] == part[:-q] for q in range(1, p))
    return sorted((s, n, p) for (s, n), p in found.items())


def judged(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_of(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def repetitive(n=160):
    """Texts of few words with stretches repeated, cut and broken, nested periods, ties, odd spaces, nulls and repeated rows."""
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "a " * 5), (5, "a " * 6), (5, "a " * 6), (6, "a b " * 4), (7, "a b " * 3 + "a"), (None, "x y z " * 9), (None, None), (8, "a a a a a a b b b b b b"), (9, "日 本 " * 7 + "x\x0by\x0cz"), (10, "A a " * 8)]
    for i in range(n):
        w = list(rng.choice(list("abcd"), int(rng.integers(0, 40))))
        for _ in range(int(rng.integers(1, 4))):
            unit = list(rng.choice(list("ab"), int(rng.integers(1, 7))))
            at, part = int(rng.integers(0, len(w) + 1)), unit * int(rng.integers(2, 8))
            w[at:at] = part[: len(part) - int(rng.integers(0, len(unit)))]
        rows.append((100 + i, ["  ", "\n", "\t"][i % 3].join(w)))
    return rows


def test_runs_match_brute_force():
    """Words of a chunk of documents, in blocks of few grid places."""
    texts = [WORD.findall(t or "") for _, t in repetitive(400)]
    at = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    number = np.unique([x for w in texts for x in w], return_inverse=True)[1]
    whole = [x.tolist() for x in periodic.runs(number, at)]
    kept, periodic.BLOCK = periodic.BLOCK, 7
    assert [x.tolist() for x in periodic.runs(number, at)] == whole
    periodic.BLOCK = kept
    doc = np.searchsorted(at, whole[0], "right") - 1
    got = sorted(zip(doc.tolist(), (np.array(whole[0]) - at[doc]).tolist(), *whole[1:], strict=True))
    assert got == [(d, *r) for d, w in enumerate(texts) for r in runs_of(w)] and len(got) > 300


def test_periodic_query_matches_brute_force(spark, monkeypatch):
    rows = repetitive()
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, collapsed string, runs array<int>")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = sorted((repr(tuple(r[c] for c in COLUMNS)) for r in queries.op11_periodic_runs(spark, "").collect()))
    assert got == sorted(repr(judged(*r)) for r in rows)
    monkeypatch.setattr(queries, "table", lambda *_: df.limit(0))
    assert queries.op11_periodic_runs(spark, "").count() == 0


def test_periodic_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: judged(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got == want and sum(r[0] for r in got.values()) > 5


def test_a_very_long_text_is_searched_whole(spark):
    w = [f"w{i}" for i in range(250_000)]
    w[120_000:240_000] = w[120_000:150_000] * 4
    got = periodic.find(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(120_000, 120_000, 30_000)] and got.n_words == 250_000 and got.collapsed == " ".join(w[:150_000] + w[240_000:])


# 12


def without_lines(rows, documents=10, min_chars=1):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < documents]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined():
    """Common lines first, last, alone, in a row and inside; blank lines; case, spaces and other white bytes; long lines; one and nine and ten documents."""
    rng = np.random.default_rng(5)
    common = ["Share this", "ÄÖ ü", "long " * 40, "x", "日本"]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "\n\n"), (None, "share THIS \n only here"), (None, None), (4, "one\n\x0b\ntwo\r\n")]
    for i in range(90):
        lines = [f"own {i} {j}" for j in range(int(rng.integers(0, 4)))]
        for c in rng.choice(5, int(rng.integers(0, 4))):
            form = [common[c], f"\t{common[c].upper() if common[c].isascii() else common[c]} ", f" {common[c]}\r"][int(rng.integers(3))]
            lines.insert(int(rng.integers(0, len(lines) + 1)), form)
        rows.append((10 + i, "\n".join(lines)))
    rows += [(300 + i, "nine times\nkeep" if i < 9 else "ten times\nkeep too") for i in range(19)]
    return rows + [rows[-1], (500, "z" * 3_000_000 + "\nx\n" + "tail")]


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_lines_match_brute_force(spark, most):
    """With the settled keys sent to all tasks, and joined."""
    rows = lined()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, found string").repartition(5)
    for documents, chars in ((10, 1), (3, 4)):
        got = line_dedup.dedup(df, documents=documents, min_chars=chars, batches=6, most=most).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted((tuple(r) for r in got), key=repr) == without_lines(rows, documents, chars)
    assert line_dedup.dedup(df.limit(0), most=most).count() == 0


def test_runs_of_lines_are_levelled(spark):
    """Settled keys aren't stored again; a full level becomes one run of the next; sums are those of all batches."""
    runs = line_dedup.Runs(spark, threshold=5, fanout=3, buckets=4)
    total = Counter()
    for b in range(10):
        counts = {k: 1 + (k * b) % 4 for k in range(40)} | {1000 + b: 1, 7: 6}
        runs.add(spark.createDataFrame(list(counts.items()), "key long, n long"))
        total.update(counts)
    assert runs.runs == [1, 0, 1]
    held = {r.key: r.n for r in spark.table(runs.level(2)).collect()}
    assert held[7] < total[7] and held[7] >= 5
    plan = runs.summed(2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {r.key for r in runs.settled().collect()} == {k for k, n in total.items() if n >= 5}


def test_runs_of_lines_as_batches_arrive(spark):
    """A store that is asked after each batch."""
    rows = lined()
    runs = line_dedup.Runs(spark, threshold=10)
    for n in (40, 80, len(rows)):
        df = spark.createDataFrame(rows[n - 40 if n < len(rows) else 80 : n], "doc_id long, text string")
        runs.add(line_dedup.line_counts(df).select("key", "n"))
        seen = spark.createDataFrame(rows[:n], "doc_id long, text string")
        got = line_dedup.stripped(seen, runs.settled()).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted((tuple(r) for r in got), key=repr) == without_lines(rows[:n])


# 13


def diverged(rows, top=200, documents=3):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= documents]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s}]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_divergences_match_brute_force(spark, monkeypatch, few):
    """Nulls, groups without terms, a language without kept terms, one with one source, repeated rows, ties, words beyond ASCII, clashing names; groups sent to all tasks, and joined."""
    monkeypatch.setattr(divergence, "SENT_GROUPS", few)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeéßn"), rng.integers(1, 5))) for _ in range(120)]
    rows = [(None, None, None), ("en", "s0", None), ("en", "empty", "12 _ 34"), ("xx", "a", "one two"), ("xx", "b", "two"), ("one", "only", "x x x"), ("one", "only", "X"), ("one", "only", "x"), ("en", None, "Tie tie tie"), ("", "s1", "tie"), ("a\0", "b", "tie"), ("a", "\0b", "tie")]
    for i in range(150):
        start = int(rng.integers(0, 60))
        rows.append((["en", "de", None][i % 3], f"s{int(rng.integers(0, 7)) * int(rng.integers(0, 2))}", " ".join(rng.choice(words[start : start + 60], int(rng.integers(0, 50))))))
    rows += [rows[-1]] * 3 + [("en", "s3", "long" * 400_000)] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, p int").repartition(4)
    assert told(divergence.audit(df)) == diverged(rows)
    assert told(divergence.audit(df, top=4, documents=1)) == diverged(rows, 4, 1)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact(spark):
    """Counts whose product with SCALE is beyond 64 bits."""
    big = [(0, 1), (1, 2), (7, 9), (10**12 - 1, 10**13 + 7), (3 * 10**13, 4 * 10**15 - 1), (10**15, 10**15 + 1)]
    got = [r.p for r in spark.createDataFrame(big, "c long, t long").select(divergence.share(F.col("c"), F.col("t")).alias("p")).collect()]
    assert got == [1 + 1_000_000_000 * (c + 1) // t for c, t in big]
