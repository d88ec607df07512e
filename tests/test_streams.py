"""Tables and streams that are stopped and go on."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyvox.sources import cache, files, manifests
from tallyvox.sources.versions import VersionedTable
from tallyvox.streaming import monitor, settled

SCHEMA = "k long, v long, t string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_upserts_are_whole_or_not_at_all(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", buckets=4)
    assert held(t) == []
    assert t.upsert(rows(spark, (1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (None, 1, "x")), 0)
    assert held(t) == [(1, 1, "a"), (2, 2, "c")]
    assert not t.upsert(rows(spark, (1, 9, "z")), 0) and t.upsert(rows(spark, (1, 9, "z")), 0, "other")

    def stop():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        t.upsert(rows(spark, (1, 0, "new"), (3, 3, "d")), 1, between=stop)
    again = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "k")
    assert held(again) == [(1, 9, "z"), (2, 2, "c")] and again.buckets == 4
    assert again.upsert(rows(spark, (1, 0, "new"), (3, 3, "d")), 1)
    assert held(again) == [(1, 0, "new"), (2, 2, "c"), (3, 3, "d")]
    assert again.upsert(rows(spark, (1, -1, "older"), (2, 5, "newer")), 2, latest="v")
    assert held(again) == [(1, 0, "new"), (2, 5, "newer"), (3, 3, "d")]
    assert again.upsert(rows(spark), 3) and not again.upsert(rows(spark), 3)
    before = held(again)
    assert again.vacuum() > 0 and held(again) == before and again.vacuum() == 0


def test_two_writers_at_once(spark, tmp_path):
    """Whoever comes second with a version fails, and the table has the first one's rows."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", buckets=2)
    with pytest.raises(FileExistsError):
        t.upsert(rows(spark, (1, 1, "slow")), 0, between=lambda: t.upsert(rows(spark, (1, 2, "quick")), 0, "other"))
    assert held(t) == [(1, 2, "quick")]


def test_stream_goes_on_after_stops(spark, tmp_path):
    """Stopped at each place a batch can be stopped at; in the end as one batch run."""
    source = spark.range(60).select((F.col("id") * 7 % 13).alias("k"), F.col("id").alias("v"), F.lit("s").alias("t"))
    source.repartition(4).write.parquet(f"{tmp_path}/in")
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", buckets=4)
    stops = {("between", 0), ("after", 1), ("between", 2), ("before", 3)}

    def handle(part, batch):
        def maybe(place):
            if (place, batch) in stops:
                stops.remove((place, batch))
                raise InterruptedError(place)

        maybe("before")
        t.upsert(part, batch, "stream", latest="v", between=lambda: maybe("between"))
        maybe("after")  # the manifest is there, the stream doesn't know

    for _ in range(6):
        query = monitor.process(monitor.watch(spark, f"{tmp_path}/in", source.schema), handle, f"{tmp_path}/check")
        try:
            query.awaitTermination()
            break
        except Exception as e:
            assert "InterruptedError" in str(e)
    assert not stops
    whole = VersionedTable(spark, f"file://{tmp_path}/w", SCHEMA, "k")
    whole.upsert(source, 0, latest="v")
    assert held(t) == held(whole) and t.manifest()["version"] == 4


def test_files_are_taken_when_they_have_settled(spark, tmp_path):
    """A file that still grows waits; each is taken once, also after a restart, on a clock's trigger."""
    settled.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"first")
    out = VersionedTable(spark, f"file://{tmp_path}/out", "path string, size long, text string", "path", buckets=2)
    growing = threading.Event()
    growing.set()

    def grow():
        with open(tmp_path / "in" / "b.txt", "wb") as f:
            while growing.is_set():
                f.write(b"x" * 10)
                f.flush()
                time.sleep(0.05)

    writer = threading.Thread(target=grow)
    writer.start()
    seen = []

    def handle(part, batch):
        named = part.select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "size", F.decode("content", "UTF-8").alias("text"))
        seen.append((batch, sorted(r.path for r in named.collect())))
        out.upsert(named, batch, "files")

    def start():
        stream = spark.readStream.format("settledfiles").option("log", f"{tmp_path}/log").option("suffix", ".txt").load(f"{tmp_path}/in")
        return monitor.process(stream, handle, f"{tmp_path}/check", every="300 milliseconds")

    def wait(for_):
        end = time.time() + 60
        while not for_() and time.time() < end:
            time.sleep(0.1)
        assert for_()

    query = start()
    wait(lambda: out.read().count() == 1)
    time.sleep(1.5)
    assert {r.path for r in out.read().collect()} == {"a.txt"}
    growing.clear()
    writer.join()
    wait(lambda: out.read().count() == 2)
    query.stop()
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "c.txt").write_bytes(b"third")
    (tmp_path / "in" / "skipped.nii").write_bytes(b"no")
    query = start()
    wait(lambda: out.read().count() == 3)
    query.stop()
    got = {r.path: r for r in out.read().collect()}
    assert got["b.txt"].size == len(got["b.txt"].text) == (tmp_path / "in" / "b.txt").stat().st_size and got["c.txt"].text == "third"
    assert sorted(p for _, ps in seen for p in ps) == ["a.txt", "b.txt", "c.txt"]


def test_monitor_ends_itself(spark, tmp_path):
    """At the target, at the merged file, after a restart, and with an error where time is up."""
    spark.range(50).repartition(5).write.parquet(f"{tmp_path}/in")
    watch = lambda: monitor.watch(spark, f"{tmp_path}/in", spark.range(1).schema)
    told = lambda into: sorted((r.batch, r.rows, r.n, r.percent, r.finished) for r in spark.read.parquet(into).collect())
    monitor.until(watch(), 25, f"{tmp_path}/p1", f"{tmp_path}/c1", every="0 seconds", most=60)
    got = told(f"{tmp_path}/p1")
    assert [r[0] for r in got] == list(range(len(got))) and got[-1][2] >= 25 and got[-1][4] and not any(r[4] for r in got[:-1]) and got[-1][3] == 100.0
    assert sum(r[1] for r in got) == got[-1][2]
    flag = tmp_path / "merged.csv"
    flag.write_text("x")
    monitor.until(watch(), 1000, f"{tmp_path}/p2", f"{tmp_path}/c2", merged=flag.exists, every="0 seconds", most=60)
    with pytest.raises(TimeoutError):
        monitor.until(watch(), 1000, f"{tmp_path}/p3", f"{tmp_path}/c3", every="0 seconds", most=8)
    assert told(f"{tmp_path}/p3")[-1][2] == 50
    spark.range(30).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    monitor.until(watch(), 70, f"{tmp_path}/p3", f"{tmp_path}/c3", every="0 seconds", most=60)
    assert told(f"{tmp_path}/p3")[-1][2:] == (80, 100.0, True)


def test_cache_is_kept_by_input(spark, tmp_path):
    """A second query reads what the first one wrote; a changed input makes it anew and drops the old one; a failed one leaves nothing."""
    made, source, at = [], f"{tmp_path}/in", f"{tmp_path}/cache"

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS twice")

    def got():
        return sorted(r.twice for r in cache.cached(spark, "t", [source], make, at=at).collect())

    spark.range(3).write.parquet(source)
    assert got() == got() == [0, 2, 4] and len(made) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert got() == got() == [0, 0, 2, 2, 4] and len(made) == 2
    assert len([p for p in (tmp_path / "cache" / "t").iterdir() if not p.name.startswith(".")]) == 1
    with pytest.raises(ZeroDivisionError):
        cache.cached(spark, "bad", [source], lambda: 1 / 0, at=at)
    assert cache.cached(spark, "t", [f"{tmp_path}/other"], lambda: spark.range(1).selectExpr("id AS twice"), at=at).count() == 1 and len(made) == 2 and got() and len(made) == 2


def test_manifests_tell_what_is_there(spark, tmp_path):
    """Files of few ids, odd category names, versions, a stop before the manifest, changed and missing files."""
    at = f"{tmp_path}/m"
    rows = [("A", f"s{i:03d}") for i in range(25)] + [("B b/=", "x"), ("B b/=", "y")]
    df = spark.createDataFrame(rows, "category string, subject_id string").repartition(3)
    told = manifests.commit(df, at, {"t": 0.5}, rows_per_file=10)
    assert {c: s["count"] for c, s in told["splits"].items()} == {"A": 25, "B b/=": 2} and len(told["splits"]["A"]["files"]) >= 3
    assert told["thresholds"] == {"t": 0.5} and "s001" not in str(told)
    back = lambda *a: sorted(tuple(r) for r in manifests.read(spark, at, *a).collect())
    assert back() == sorted(rows) and back(["B b/="]) == [("B b/=", "x"), ("B b/=", "y")] and back(["none"]) == []
    manifests.commit(df.where("category = 'A' and subject_id < 's003'"), at, {})
    assert back() == [("A", f"s{i:03d}") for i in range(3)] and manifests.latest(spark, at)["version"] == 2
    part = next(p for p in (tmp_path / "m" / manifests.latest(spark, at)["folder"]).rglob("part-*"))
    part.write_text(part.read_text().replace("s001", "s009"))
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="aren't those"):
        back()
    manifests.commit(df.limit(0), at, {})
    assert back() == []
    with pytest.raises(FileNotFoundError):
        manifests.read(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("sent", [100, 0])
def test_aliases_by_pieces_of_paths(spark, sent):
    """As a search for each alias in each path; no join without a key."""
    subjects = ["BDMAP_00000012", "BDMAP_00000120", "P7", "00", "", "BDMAP_", "none"]
    paths = ["a/BDMAP_00000012.nii", "b/12_consensus.nii", "b/12.nii", "c/120/x", "c/0120_Consensus", "P7/P7/P7", "", "7", "x00000012y"]
    found = files.by_alias(spark.createDataFrame([(s,) for s in subjects], "subject_id string"), spark.createDataFrame([(p,) for p in paths], "path string"), sent=sent)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = set()
    for s in subjects:
        bare = s.replace("BDMAP_", "")
        hits = [(n, "consensus" not in p.lower(), p, a) for n, a in enumerate(dict.fromkeys([s, bare, bare.lstrip("0")])) for p in paths if a and a in p]
        if hits:
            want.add((s, min(hits)[3], min(hits)[2]))
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 4
