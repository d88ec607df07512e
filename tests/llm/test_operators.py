"""The operators of the corpus pipeline against brute force, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import decontam, eflm, importance, jaccard_join, packing, quality_rules, queries, repair, suffix_dedup, url_filter, warc
from tallyvox.llm.eliasfano import Level, Sequence
from tallyvox.llm.graph import components
from tallyvox.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty, blank and very long texts, repeated rows, near copies, a hot passage, texts beyond Latin-1."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdeghinorst"), rng.integers(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = prose(120), prose(90)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base), (6, base + " tail"), (7, base.replace(" ", "  ", 3).upper()), (None, prose(30)), (None, None), (8, "one two three"), (9, "One TWO three"), (10, "x"), (11, prose(20_000)), (12, "日本語 テキスト " * 30), (13, "it's <|endoftext|> don't"), (14, "For " * 700)]
    rows += [(20 + i, prose(int(rng.integers(20, 80))) + " " + passage + " " + prose(int(rng.integers(20, 80)))) for i in range(30)]
    copies = base.split()
    for i in range(25):
        w = list(copies)
        for at in rng.integers(0, len(w), 1 + i % 6):
            w[at] = vocabulary[rng.integers(300)]
        rows.append((100 + i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, odd):
    """The rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "row", 1, "x", 2.0) for i, t in odd], "doc_id long, text string, row string, doc int, found string, key double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1


def test_hosts_and_rules(spark):
    urls = ["http://A.B.net/x?y", "https://shop.example.net/en/1#z", "http://example.com", "http://example.com/de/", "https://a.org/fr/2", "no scheme", "", None, "x://net/", "x://net", "http://notnet/", "ftp://u.net:80/p/q"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert [got[i].host for i in range(12)] == ["a.b.net", "shop.example.net", "example.com", "example.com", "a.org", "", "", "", "net", "net", "notnet", "u.net:80"]
    assert [got[i].path for i in range(12)] == ["/x", "/en/1", "", "/de/", "/fr/2", "", "", "", "/", "", "/", "/p/q"]
    assert [got[i].rule for i in range(12)] == ["net/", "example.net/en/", None, "example.com/de/", "org/fr/", None, None, None, "net/", None, None, None]
    assert got[0].verdict == "block" and got[1].verdict == "allow" and got[3].verdict == "block" and got[7].verdict == "allow"
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_url_scores_match_brute_force(spark):
    """Scores, calibration and verdicts, with repeated rows, a very long URL, ties and columns whose names clash."""
    urls = [f"http://{'casino' if i % 4 == 0 else 'garden'}{'spam' if i % 8 == 0 else ''}{i % 7}.example.org/{'abcdefgh'[i % 8] * (i % 5)}{i}" for i in range(240)]
    urls += [urls[5], urls[8], "http://garden.example.org/" + "long-path/" * 800, "", None, "no scheme casino"]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id int, url string, HOST string, score double")
    rows = {r.page_id: r for r in df.select("page_id", url_filter.grams(df.url).alias("g"), (F.xxhash64(url_filter.grams(df.url)) % url_filter.HELD_OUT == 0).alias("aside")).collect()}
    fold = lambda u: [url_filter.ALPHABET.find("0" if c.isdigit() else c) + 1 or 31 for c in u.split("://")[-1].lower()]
    for i, u in enumerate(urls):
        c = [0, 0, 0, *fold(u or "")]
        assert (rows[i].g or []) == [((c[j] * 32 + c[j + 1]) * 32 + c[j + 2]) * 32 + c[j + 3] for j in range(len(c) - 3)]
    good = [not any(s in url for s in url_filter.REJECT_SEEDS) if (url := (u or "").split("://")[-1].split("/")[0] if u and "://" in u else "") else True for u in urls]
    count = {k: [Counter() for _ in range(4)] for k in (True, False)}
    for i, r in rows.items():
        for g in r.g or [] if not r.aside else []:
            for order in range(4):
                count[good[i]][order][g % 32 ** (order + 1)] += 1
    total = sum(sum(count[k][0].values()) for k in count)
    often = Counter()
    for k in count:
        for g, n in count[k][3].items():
            often[g // 32] += n
    used = {c for c, n in often.items() if n >= max(url_filter.LEAST_SEEN, total / url_filter.CONTEXTS)}
    assert 10 < len(used) < len(often)

    def p(k, g, order):
        if order < 0:
            return 1 / 32
        low, c = p(k, g % 32**order if order else 0, order - 1), count[k][order]
        after = [n for x, n in c.items() if x // 32 == g // 32]
        return (c[g] + len(after) * low) / (sum(after) + len(after)) if after else low

    def score(gs):
        w = [math.log(p(True, g if o == 3 else g % 32**3, o)) - math.log(p(False, g if o == 3 else g % 32**3, o)) for g in gs for o in [3 if g // 32 in used else 2]]
        return sum(w) / len(w)

    got = {r.page_id: r for r in url_filter.judge(df, []).collect()}
    assert set(next(iter(got.values())).asDict()) == {"page_id", "url", "host", "path", "rule", "score", "probability", "threshold", "verdict"}
    want = {i: score(r.g) for i, r in rows.items() if r.g and len(r.g) < 200}
    assert all(abs(got[i].score - x) < 1e-3 for i, x in want.items()) and got[240].score == got[5].score and got[243].score is None and got[244].verdict == "allow"
    assert got[242].score > 0
    bins = Counter((max(-8, min(8, round(round(got[i].score / 0.05) * 0.05, 6))), good[i]) for i, r in rows.items() if r.g and r.aside)
    n1, n0 = (sum(n for (_, k), n in bins.items() if k == which) for which in (True, False))
    loss = lambda a, b: sum(n * url_filter.bent((n1 + 1) / (n1 + 2) if k else 1 / (n0 + 2), a * x + b) for (x, k), n in bins.items())
    logit = lambda x: math.log(x / (1 - x))
    (i, x), (j, y) = ((k, logit(got[k].probability)) for k in (0, 1))
    slope = (x - y) / (got[0].score - got[1].score)
    offset = x - slope * got[0].score
    best = loss(slope, offset)
    assert all(loss(slope + a, offset + b) >= best - 1e-5 for a, b in product((-0.05, 0, 0.05), repeat=2))
    assert abs(got[1].threshold + offset / slope) < 1e-6
    assert all((got[k].verdict == "block") == (got[k].score is not None and got[k].score < got[k].threshold) for k in got)
    assert np.mean([(got[k].verdict == "allow") == good[k] for k in range(240)]) > 0.98
    one = url_filter.judge(df.where("page_id % 4 = 1 and page_id < 240"), []).collect()  # no rejected example
    assert {r.verdict for r in one} == {"allow"} and {r.score for r in one} <= {0.0, None}


# 2


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[find(a)] = find(b)
    least = {}
    for x, (i, s) in enumerate(sets):
        r = find(x)
        if i is not None and s:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(frame, odd, k, percent):
    got = jaccard_join.join(frame, shingle=k, percent=percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(odd, k, percent)


def test_one_document_of_each_group_stays(spark, frame, odd):
    kept = jaccard_join.one_of_each(frame, shingle=5, percent=80)
    found = brute_components(odd, 5, 80)
    alone = [i for i, n, c in found if not n]
    named = {c for i, n, c in found if n and c is not None}
    unnamed = sum(1 for i, n, c in found if n and c is None)  # one row
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame.columns
    assert sorted(got, key=repr) == sorted([*alone, *named, *[None] * unnamed], key=repr)
    same = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, "x y z"), (None, "x y z"), (6, ""), (6, "")], "doc_id long, text string")
    assert rows_of(jaccard_join.one_of_each(same), "doc_id", "text") == sorted([(4, "a b c d e f"), (None, "x y z"), (6, ""), (6, "")], key=repr)


def test_jaccard_of_nothing(empty):
    assert jaccard_join.join(empty).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}


# 3


def test_base_counts_and_verdicts(spark, frame, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.judge(frame, labels)
    want = []
    for i, t in odd:
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {x for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert rows_of(got, "doc_id", *quality_rules.COUNTS, "base_failed") == sorted(want, key=repr)
    assert all(not r.kept for r in got.collect() if r.base_failed)
    assert quality_rules.judge(frame, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_probabilities_match_brute_force(spark, odd):
    """Also with repeated labelled ids, and with room for a part of the sample only."""
    good = [(1000 + i, f"plain words here {' '.join(f'word{(i * j) % 50}' for j in range(1, 30))}") for i in range(24)]
    bad = [(2000 + i, f"win $$$ now {' '.join(f'cash{(i * j) % 9} !!!' for j in range(1, 20))}") for i in range(24)]
    rows = [*good, *bad, *good[:3], (1000, "another text of the same id and label as one above, of some ten words"), *odd]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad), (1000, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for room in (quality_rules.FIT_BYTES, 20_000):
        some, prior = quality_rules.sample(docs.select("doc_id", "text"), labels, fit_bytes=room)
        assert (len(some) == 48) == (room > 20_000) and sum(len(r[0]) * 8 for r in some) <= 2 * room and prior == 0.5
    some, prior = quality_rules.sample(docs.select("doc_id", "text"), labels)
    w, b = quality_rules.fit(some, prior)
    want, n = [], quality_rules.BUCKETS

    def hashed(*parts):
        h = np.array([quality_rules.tx.Chunk(None, np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes(np.array([0]), np.array([len(x)]))[0] for x in parts])
        return int(h[0]) if len(h) == 1 else int(quality_rules.tx.windows(h, np.array([0, 2]), 2)[0][0])

    for i, t in rows:
        if len(t or "") > 3000:
            continue
        raw = (t or "").encode()
        low = (t or "").translate(LOWER).encode()
        tokens = [x.encode() for x in WORD.findall(t or "")]
        kinds = ([hashed(x) % n for x in tokens], [hashed(x, y) % n + n for x, y in zip(tokens, tokens[1:], strict=False)], [((int.from_bytes(low[j : j + 3]) * 0x9E3779B1 % 2**32) >> 17) + 2 * n for j in range(len(raw) - 2)])
        score = b + sum(sum(w[x] for x in k) / len(k) for k in kinds if k)
        want.append((i, round(1 / (1 + math.exp(-score)), 6)))
    got = [(r.doc_id, round(r.probability, 6)) for r in quality_rules.judge(docs.where("length(coalesce(text, '')) <= 3000"), labels).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_features_do_not_depend_on_the_next_document():
    texts = ["abcd", "", "x", None, "yz", "some more words", "q"]
    chunk = lambda of: next(quality_rules.tx.chunks([pa.record_batch({"text": pa.array(of, pa.string())})]))
    alone = [quality_rules.features(chunk([t])) for t in texts]
    for kind, (ids, at) in enumerate(quality_rules.features(chunk(texts))):
        for k, one in enumerate(alone):
            assert ids[at[k] : at[k + 1]].tolist() == one[kind][0].tolist()


def test_quality_model_holds_out_of_sample(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit_on = labels.where("doc_id % 2 = 0")
    got = quality_rules.judge(docs, fit_on).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    good = [r.kept for r in got if r.quality == 1]
    assert np.mean(right) > 0.9 and np.mean(good) > 0.97


# 4


def test_importance_sample(spark):
    """Held-out labels: the model sees a half of them. Clean text stays, nearly all bad text and most toxic text goes."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    targets = queries.targets(spark, "/root/testdata/sf0.1").where("doc_id % 2 = 0")
    sampled, kept = importance.select(docs, targets)
    ids = {r.doc_id for r in sampled.select("doc_id").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and kept.columns == docs.columns
    unseen = labels.where("doc_id % 2 = 1").collect()
    share = lambda q, t: np.mean([r.doc_id in ids for r in unseen if (r.quality, r.toxic) == (q, t)])
    assert share(1, 0) > 0.98 and share(0, 0) < 0.1 and share(1, 1) < 0.45


def test_importance_weights_match_brute_force(spark, frame, odd):
    alnum, seed = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 1
    target = [i for i, t in odd if i is not None and i % 2 == 0]
    labels = spark.createDataFrame([(i, True) for i in target] + [(3, False), (None, True), (4, None)], "doc_id long, target boolean")
    aside = {r[0] for r in spark.createDataFrame([(i,) for i in target], "doc_id long").where(f"pmod(xxhash64(doc_id, 'aside'), {importance.ASIDE}) = 0").collect()}
    grams = {}
    for k, (_, t) in enumerate(odd):
        low = (t or "").translate(LOWER)
        raw = low.encode()
        w = alnum.findall(low)
        grams[k] = [Counter(w), Counter(x == y for x, y in zip(w, w[1:], strict=False)), Counter((int.from_bytes(raw[j : j + 3]) * 0x9E3779B1 % 2**32) >> 16 for j in range(len(raw) - 2))]
    want = {}
    ratio = []
    for kind, share in ((0, 1), (1, 1), (2, 1 / 8)):
        of, near = Counter(), Counter()
        for k, (i, _) in enumerate(odd):
            of.update(grams[k][kind])
            if i in target and i not in aside:
                near.update(grams[k][kind])
        n, m, out = sum(of.values()), sum(near.values()), {}
        for g, c in of.items():
            e = c * m / n
            r = math.log((near[g] + 1) / (e + 1))
            out[g] = share * r if kind == 1 or abs(r) >= importance.LEAST and abs(near[g] - e) >= importance.DEVIATIONS * math.sqrt(e + 1) else 0
        ratio.append(out)
    assert any(x for out in ratio for x in out.values())
    want = [(i, sum(min(0, sum(c * ratio[kind][g] for g, c in grams[k][kind].items())) for kind in range(3))) for k, (i, _) in enumerate(odd)]
    cut = sorted((w for i, w in want if i in aside), reverse=True)[max(1, math.floor(importance.KEEP * sum(i in aside for i, _ in want))) - 1]
    noise = dict(zip([i for i, _ in want], importance.gumbel(np.array([-1 if i is None else i for i, _ in want]), seed), strict=True))
    keys = sorted((round(round(w, 6) + noise[i], 6) for i, w in want), reverse=True)
    bar = keys[sum(w >= cut - 1e-6 for _, w in want) - 1]
    sampled, kept = importance.select(frame, labels, seed=seed)
    got = sorted(((r.doc_id, r.log_weight, r.key) for r in sampled.collect()), key=repr)
    expected = sorted(((i, round(w, 6), round(round(w, 6) + noise[i], 6)) for i, w in want if round(w, 6) + noise[i] >= bar - 1e-5), key=repr)
    assert [g[0] for g in got] == [e[0] for e in expected] and kept.count() == len(got)
    assert all(abs(g[1] - e[1]) < 1e-4 * (1 + abs(e[1])) and abs(g[2] - e[2]) < 1e-4 * (1 + abs(e[2])) for g, e in zip(got, expected, strict=True))
    x = importance.gumbel(np.arange(100_000), 3)
    assert abs(x.mean() - 0.5772) < 0.02 and abs(x.std() - math.pi / math.sqrt(6)) < 0.02


def test_kth_largest_is_exact(spark):
    keys = np.random.default_rng(1).normal(0, 50, 3000).round(9)
    keys[100:140], keys[500], keys[501:1501] = keys[7], -1e9, 1e7 + np.arange(1000)
    df = spark.createDataFrame([(float(k),) for k in keys], "key double")
    for k in (1, 30, 900, 2300, 2310, 3000):
        want = float(np.sort(keys)[::-1][k - 1])
        assert importance.kth_largest(df, k) == want


def test_importance_on_odd_rows(spark, frame, empty):
    none = spark.createDataFrame([], "doc_id long, target boolean")
    _, kept = importance.select(frame, none)
    assert kept.columns == frame.columns and kept.count() == frame.count()
    assert importance.select(empty, none)[1].count() == 0


# 5


def brute_revisits(records):
    out = []
    for r in records:
        if r["status"] != 304:
            continue
        past = [x for x in records if x["status"] == 200 and x["url"] == r["url"] and x["ts"] < r["ts"]] if r["url"] is not None and r["ts"] is not None else []
        last = max(past, key=lambda x: (x["ts"], x["record_id"]), default=None)
        tag = lambda x: re.sub("^W/", "", x)
        if last is None:
            said = "no_response"
        elif r["etag"] is None and r["last_modified"] is None:
            said = "unverified"
        elif r["etag"] is not None and last["etag"] is not None:
            said = "resolved" if tag(r["etag"]) == tag(last["etag"]) else "mismatch"
        else:
            said = "resolved" if r["last_modified"] is not None and r["last_modified"] == last["last_modified"] else "mismatch"
        out.append((r["record_id"], said, last and last["record_id"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_revisits(spark, ranges):
    rng = np.random.default_rng(3)
    pick = lambda *x: x[rng.integers(len(x))]
    records = [{"record_id": i, "url": pick("a.example/1", "a.example/1", "a.example/1", "b.example/2", None), "ts": pick(None, *range(60)), "status": pick(200, 304, 304, 404), "etag": pick(None, "x", "W/x", "y"), "last_modified": pick(None, "d1", "d2"), "headers": pick(None, {"Age": "1", "content-length": "9"})} for i in range(300)]
    for r in records:
        r["ts"] = None if r["ts"] is None else int(r["ts"])
    df = spark.createDataFrame(records, "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>")
    got = warc.resolve(df, ranges=ranges)
    assert rows_of(got, "record_id", "outcome", "response_id") == brute_revisits(records)
    assert warc.resolve(df.limit(0)).count() == 0


def test_headers_and_urls(spark):
    rows = [(1, "HTTP://www.Example.com:80/a/?utm_source=x&q=1#f", 1, 200, "t", None, {"Content-Type": "text/html", "Age": "1", "AGE": "0", "X": "y"}), (2, "https://example.com/a/?q=1", 2, 304, "t", None, {"age": "2", "Age": "3", "Content-Type": "none", "New": "z", "None": None})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>")
    r = warc.resolve(df).first()
    assert r.canonical_url == "example.com/a/?q=1" and r.headers == {"content-type": "text/html", "x": "y", "age": "2", "new": "z", "none": None}


# 6


def test_decontamination_moves_no_text(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    for found in (decontam.contamination(docs, items), decontam.clean(docs, items)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(("span", "few"), [(10, 1 << 21), (3, 1 << 21), (3, 0)])
def test_decontamination(spark, frame, odd, span, few, monkeypatch):
    monkeypatch.setattr(decontam, "FILTER_WORDS", few)  # with too many words for a filter, all are stored
    monkeypatch.setattr(decontam, "SENT_BYTES", few)  # and candidates are merged
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall((t or "").translate(LOWER))
    passage = cut(odd[20][1])
    items = [(1, " ".join(passage[30:60])), (2, "two THREE"), (3, None), (4, ""), (5, "x"), (6, " ".join(passage[30:60])), (7, "for for for"), (8, "nowhere to be found at all in these texts of ours today"), (None, " ".join(passage[70:85])), (None, None), (1, " ".join(passage[30:60]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in odd:
        w, hit, names = cut(t), set(), set()
        for name, x in items:
            x = cut(x)
            k = min(span, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == x[a : a + k]:
                        hit.update(range(b, b + k))
                        names |= {str(name)} - {"None"}
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    got = decontam.contamination(frame, df, span=span)
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    kept = decontam.clean(frame, df, span=span)
    assert kept.columns == frame.columns and kept.count() == sum(not w[-1] for w in want)
    assert not decontam.contamination(frame, df.limit(0)).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare0 filler rare1 filler filler rare2"), (2, "rare0 " + "filler " * 60 + "rare1"), (3, "filler")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "rare0 rare1 rare2")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.Index(docs, items).proximity(5, 2).collect()} == {(1, "9")}


# 7 and 8


@pytest.fixture(scope="module")
def expected_ids(odd):
    e = Encoder.of(queries.tokenizer_file())
    return {(i, t): np.append(e.ids(t or ""), 0).astype("<u4") for i, t in odd}


def test_packing(frame, odd, expected_ids):
    got = packing.pack(frame, queries.tokenizer_file()).collect()
    filled = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in got)
    at = 0
    for begin, n in filled:
        assert begin == at
        at += n
    assert at == sum(len(expected_ids[x]) for x in odd) and all(r.offset + r.length <= 1024 for r in got)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    for i in {i for i, _ in odd if i is not None and i != 4}:
        whole = b"".join(x for _, x in sorted(pieces[i]))
        assert whole == next(v for k, v in expected_ids.items() if k[0] == i).tobytes()
    assert packing.padded_length(np.array([512, 513, 1, 1024])).tolist() == [512, 1024, 1, 1024]
    last = at - at // 1024 * 1024 or 1024
    assert {r.padded_length for r in got if r.sequence_id == (at - 1) // 1024} == {last if last & (last - 1) == 0 else 1024} and {r.padded_length for r in got if r.sequence_id < (at - 1) // 1024} == {1024}


def test_repair_round_trip(frame, odd, expected_ids):
    stored = repair.write(frame, queries.tokenizer_file(), block=4096)
    got = sorted(repair.read(stored).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        assert any(zlib.crc32(r.ids) == zlib.crc32(v.tobytes()) for k, v in expected_ids.items() if k[0] == r.doc_id)


def test_repair_blocks():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, np.uint32), np.array([7]), np.zeros(999, np.uint32), rng.integers(0, 5, 5000), np.tile([1, 2, 3, 1, 2], 400), rng.integers(0, 50_000, 3000)):
        at = np.unique(np.concatenate([[0, len(ids)], rng.integers(0, len(ids) + 1, 20)]))
        b = repair.Block.from_bytes(repair.Block.of(ids.astype(np.uint32), at, 50_257).to_bytes())
        assert np.array_equal(b.decode(), ids)
        for k in range(len(at) - 1):
            assert np.array_equal(b.decode(k, k + 1), ids[at[k] : at[k + 1]])
    with pytest.raises(ValueError):
        repair.Block.from_bytes(b"none of ours")


def test_empty_tables_pack_and_encode(empty):
    assert packing.pack(empty, queries.tokenizer_file()).count() == 0
    assert repair.read(repair.write(empty, queries.tokenizer_file())).count() == 0


def test_piecewise_encoding_is_the_tokenizers():
    e = Encoder.of(queries.tokenizer_file())
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list(" \n\tab1é.,\xa0-²'!"), rng.integers(0, 40))) for _ in range(2000)] + [None, "", "日本", "<|endoftext|>"]
    ids, at = e.encode(texts, 0)
    for k, t in enumerate(texts):
        assert np.array_equal(ids[at[k] : at[k + 1]], np.append(e.ids(t or ""), 0)), repr(t)


# 9


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 5), (10, 10), (1000, 50), (1000, 10**6), (5000, 10**9), (3, 2**33)):
        v = np.sort(rng.integers(0, top + 1, n))
        head, low, high = Sequence.arrays(v)
        s = Sequence(int(head[0]), int(head[1]), low, high)
        x = np.concatenate([rng.integers(0, top + 3, 500), v])
        place, same = s.find(x)
        assert (s.get(np.arange(n)) == v).all() and (place == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()
    k = np.unique(rng.integers(0, 50, 3000) * 5000 + rng.integers(0, 5000, 3000))
    level = Level.of(Level.arrays(k // 5000, k % 5000, 60))
    q, w = rng.integers(0, 60, 3000), rng.integers(0, 5000, 3000)
    there = dict(zip(k.tolist(), range(len(k)), strict=True))
    assert level.child(np.arange(60), w, q).tolist() == [there.get(a * 5000 + b, -1) for a, b in zip(q.tolist(), w.tolist(), strict=True)]


def test_lm_scores(frame, odd):
    docs = frame.select("doc_id", "text", eflm.held_out(frame.doc_id).alias("held_out"))
    got = eflm.score(eflm.train(docs.where("not held_out")), docs, keep=("doc_id", "held_out"))
    both = eflm.train(docs.withColumn("training", ~docs.held_out), keep=("doc_id", "held_out"), training="training")
    assert rows_of(eflm.score(both, keep=("doc_id", "held_out")), *got.columns[:-2]) == rows_of(got, *got.columns[:-2])
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*words(t), None]) for i, t in odd]
    c = Counter(w for _, out, t in tokens if not out for w in t)
    total = sum(c.values())
    want = sorted(((i, out, len(t), sum(w in c for w in t), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in t), 6)) for i, out, t in tokens), key=repr)
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()]
    assert sorted(rows, key=repr) == want
    assert sum(r.score for r in got.collect()) > sum(r.base_score for r in got.collect())


def test_lm_probabilities_sum_to_one(spark, frame):
    trained = eflm.train(frame)
    m = eflm.Model(trained.head)
    key = np.array([r.key for r in trained.counts.collect()]).view(np.uint64)
    number = m.words.find(key)
    assert (number >= 0).all()
    for context in range(6):
        h = np.empty(2 * len(key), np.uint64)
        h[0::2], h[1::2] = key[number == context], key
        total = (10 ** m.score(h, np.arange(0, len(h) + 1, 2))[1::2]).sum()
        assert abs(total + 1 / (m.total + m.distinct + 1) - 1) < 0.1  # 8-bit probabilities


def test_lm_keeps_all_ngrams_that_occur_again(spark):
    """More context words than 2 ** 16, and a model in many parts: each value is that of brute force, up to 8 bits."""
    rows = [(i, " ".join(f"w{j} then x{j} w{j} then x{j} then w{j % 7}" for j in range(i * 500, (i + 1) * 500))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    docs = [(i, ["", "", *t.split(), "."]) for i, t in rows]
    grams = [Counter() for _ in range(3)]
    for _, t in docs:
        for j in range(2, len(t)):
            for k in range(3):
                if k == 0 or t[j - k] != "":
                    grams[k][tuple(t[j - k : j + 1])] += 1
    total, distinct = sum(grams[0].values()), len(grams[0])
    of, back = [None, Counter(), Counter()], [None, Counter(), Counter()]
    for k in (1, 2):
        for g, n in grams[k].items():
            of[k][g[:-1]] += n
            back[k][g[:-1]] += n - eflm.DISCOUNT if n >= 2 else 0

    def p(g):
        if len(g) == 1:
            return (grams[0][g] + 1) / (total + distinct + 1)
        k = len(g) - 1
        n, low = of[k][g[:-1]], p(g[1:])
        c = grams[k][g]
        return (max(0, c - eflm.DISCOUNT) if c >= 2 else 0) / n + (1 - back[k][g[:-1]] / n) * low if n else low

    more = [(900, ["", "", "then", "w3", "nowhere", "then", "then", "."]), (901, ["", "", "."])]
    want = {i: sum(math.log10(p(tuple(t[j - 2 : j + 1]))) for j in range(2, len(t))) for i, t in docs[-3:] + more}
    for words, part_tokens in ((1000, 50_000), (1000, 1 << 21), (1 << 19, 50_000), (4, 9_000)):  # with "then" split and not, many and few words with numbers
        trained = eflm.train(frame, words=words, part_tokens=part_tokens)
        assert words > 4 or eflm.Model(trained.head).split.max() > 9
        got = {r.doc_id: r.score for d in (None, spark.createDataFrame([(i, " ".join(t[2:-1])) for i, t in more], "doc_id long, text string")) for r in eflm.score(trained, d).collect()}
        assert all(abs(got[i] - x) < 0.01 * abs(x) for i, x in want.items())


def test_lm_without_training_text(empty, frame):
    assert {r.score for r in eflm.score(eflm.train(empty), frame).collect()} == {0.0}
    assert eflm.score(eflm.train(frame), empty).count() == 0 and eflm.score(eflm.train(empty)).count() == 0


# 10


def brute_repeats(rows, length=400):
    seen = Counter(b[j : j + length] for _, t in rows for b in [(t or "").encode()] for j in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), sum(1 for j, y in enumerate(gone) if y and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "length"), [(4096, 400), (2, 400), (4096, 200), (2, 64)])
def test_repeated_strings(frame, odd, limit, length):
    got = suffix_dedup.report(frame, limit=limit, length=length, short=length // 2)
    assert rows_of(got, *got.columns[:5]) == brute_repeats(odd, length)
    assert rows_of(got, "doc_id", "n_bytes", "n_repeated") == sorted([(i, n, gone) for i, n, gone, _, _ in brute_repeats(odd, length // 2)], key=repr)


def test_repair_leaves_no_frequent_pair():
    """On ids of real text, on overlapping pairs and on random ids of few values."""
    import pyarrow.parquet as pq

    encoder = Encoder(queries.tokenizer_file())
    ids, _ = encoder.encode(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist(), 0)
    v, rng = len(encoder.bytes_per_id), np.random.default_rng(1)
    cases = [ids[i : i + repair.BLOCK] for i in range(0, len(ids), repair.BLOCK)] + [rng.integers(0, k, 40_000) for k in (2, 5, 300)] + [np.array([1, 1, 1, 2] * 99), np.array([3] * 1000), np.array([1, 2] * 9 + [2, 1] * 8)]
    for x in cases:
        for least in (8, 2):
            seq, rules = repair.compress(x, v, least=least)
            n = Counter((a, b) for a, b in zip(seq.tolist(), seq[1:].tolist()) if a != b)
            assert max(n.values(), default=0) < least
            assert (repair.Block(v, rules, repair.lengths(rules, v), seq.astype(np.int64), np.array([0, len(x)])).decode() == x).all()


def test_ids_of_long_pieces():
    """Numbers of ids have 31 bits; unbroken texts, alone, repeated and beside others, have the tokenizer's ids."""
    encoder, rng = Encoder(queries.tokenizer_file()), np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefghijklmnop"), 300_000))
    assert encoder.size.dtype == np.int32 and encoder.place.dtype == np.int32
    for texts in ([long], ["a b", long + " c " + long, "a b"], [long[:1000], "a b"]):
        got, at = encoder.encode(texts, 0)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert got[a : b - 1].tolist() == encoder.ids(t).tolist() and got[b - 1] == 0


def test_texts_without_repeats(frame, odd, empty):
    got = suffix_dedup.remove(frame)
    want = [n - gone for _, n, gone, _, _ in brute_repeats(odd) if n - gone or not gone]
    assert got.columns == frame.columns and got.count() == len(want)
    assert sorted(len((r.text or "").encode()) for r in got.collect()) == sorted(want)
    assert suffix_dedup.report(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


def test_two_stage_suffix_order():
    rng = np.random.default_rng(2)
    for text in (b"banana", b"aaaaaaaa", b"abcabcabcabd", bytes(rng.integers(97, 100, 300, dtype=np.uint8)), b"z", bytes(range(255, 0, -1))):
        t = np.frombuffer(text, np.uint8)
        order = suffix_dedup.suffix_order(t, np.ones(len(t), bool), len(t))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: text[i:])  # noqa: B023


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        now = {r.doc_id for r in found.select("doc_id").collect()}
        assert now and now <= ids, name
        if name != "packing":
            assert found.columns == docs.columns
            docs = spark.createDataFrame(found.collect(), docs.schema)
            ids = now
    assert now == ids


def test_pipeline_stages_match_brute_force(spark, odd, expected_ids):
    """Each stage on the odd rows, with columns that operators use themselves."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, same long, found string, key double, spans string"
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "row", 1, 2, "x", 2.0, None) for i, t in odd], schema)
    for name, f in corpus_pipeline.STAGES:
        nothing = f(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and (name == "packing" or nothing.columns == docs.columns)

    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    targets = queries.targets(spark, SF)
    sampled, _ = importance.select(docs, targets)
    assert ids(stage["quality"](spark, docs, SF)) == ids(sampled)  # weights and keys have a test of their own

    found = brute_components(odd, 5, 80)
    want = [i for i, n, c in found if not n] + list({c for _, n, c in found if n and c is not None}) + [None] * sum(1 for i, n, c in found if n and c is None)
    assert ids(stage["near_duplicates"](spark, docs, SF)) == sorted(want, key=repr)

    kept = []
    seen = Counter(b[j : j + 200] for _, t in odd for b in [(t or "").encode()] for j in range(len(b) - 199))
    for i, t in odd:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        rest = bytes(x for x, y in zip(b, gone, strict=True) if not y).decode("utf-8", "ignore")
        if rest or not any(gone):
            kept.append((i, t if t is None else rest, None if t is None else len(rest)))
    assert rows_of(stage["repeated_strings"](spark, docs, SF), "doc_id", "text", "n_chars") == sorted(kept, key=repr)

    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall((t or "").translate(LOWER))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = [(900, "before " + " ".join(cut(items[0])[:12]) + " after"), (901, " ".join(cut(items[1])[:9])), (None, items[2])]
    more = docs.unionByName(spark.createDataFrame(leaky, "doc_id long, text string"), allowMissingColumns=True)
    windows = {tuple(w[j : j + min(10, len(w))]) for x in items for w in [cut(x)] if w for j in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = [i for i, t in [*odd, *leaky] if not any(tuple(w[j : j + k]) in windows for w in [cut(t)] for k in sizes for j in range(len(w) - k + 1))]
    assert len(clean) < len(odd) + 3 and ids(stage["benchmark_leaks"](spark, more, SF)) == sorted(clean, key=repr)

    pieces = stage["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(expected_ids[x]) for x in odd)
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in odd)


def test_pipeline_runs_end_to_end(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


THUE_MORSE = "a"
while len(THUE_MORSE) < 2048:
    THUE_MORSE += THUE_MORSE.translate(str.maketrans("ab", "ba"))


def test_strings_that_a_polynomial_hash_takes_for_equal(spark):
    """Thue-Morse strings and their complements: ids, lines, sets, hits, spans and scores tell them apart."""
    a, b = ([x[:n] for n in (1024, 2048)] for x in (THUE_MORSE, THUE_MORSE.translate(str.maketrans("ab", "ba"))))
    e = Encoder(queries.tokenizer_file())
    for x in [*a, *b]:
        assert np.array_equal(e.encode([x, f"{x} {x}"], 0)[0], np.concatenate([e.ids(x), [0], e.ids(f"{x} {x}"), [0]]))
    rows = [(k, " ".join([x] * 12) + f"\n{x}\n{y}") for k, (x, y) in enumerate(zip([*a, *b], [*b, *a], strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.n_dup_lines for r in quality_rules.judge(docs, none).collect()} == {0}
    assert rows_of(jaccard_join.join(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85)
    items = spark.createDataFrame([(1, " ".join([a[0]] * 10)), (2, " ".join([b[1]] * 10))], "item_id long, text string")
    assert rows_of(decontam.contamination(docs, items), "doc_id", "n_items") == [(0, 1), (1, 0), (2, 0), (3, 1)]
    got = suffix_dedup.report(docs)
    assert rows_of(got, *got.columns[:5]) == brute_repeats(rows)
    scores = eflm.score(eflm.train(docs.where("doc_id = 0")), docs)
    assert [r.n_known for r in scores.orderBy("doc_id").collect()] == [15, 1, 15, 1]
    pieces = {(r.doc_id, r.start): bytes(r.ids) for r in packing.pack(docs, queries.tokenizer_file(), length=1 << 20).collect()}
    assert all(pieces[i, 0] == np.append(e.ids(t), 0).astype("<u4").tobytes() for i, t in rows)
