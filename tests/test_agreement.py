"""Operators against numpy, on fixed cubes and random data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox.operators import agreement, curate, distance, ensemble, grid, loss, report, respace, surface, topology, windows
from tallyvox.operators.quantile import quantiles
from tallyvox.sources import files, formats, tables, volumes


def cube(rater, x, y, z, label=1, subject="s"):
    return [(subject, rater, i, j, k, label) for i in range(*x) for j in range(*y) for k in range(*z)]


@pytest.fixture(scope="module")
def two_cubes(spark):
    return spark.createDataFrame(cube("a", (5, 15), (5, 15), (5, 15)) + cube("b", (6, 14), (6, 14), (6, 14)), "subject string, rater string, x int, y int, z int, label int")


def test_two_cubes(two_cubes):
    assert {(r.rater, r.n) for r in surface.shell(two_cubes, ["subject", "rater"]).groupBy("rater").agg(F.count("*").alias("n")).collect()} == {("a", 488), ("b", 296)}
    d = surface.surface_distances(two_cubes, ["subject"], (1.5, 1.5, 2.0)).first()
    assert (round(d.hd95, 5), round(d.asd, 5), round(d.nsd, 5)) == (2.5, 1.72393, 0.89344)
    pairs = agreement.co_located(two_cubes.withColumn("r", (F.col("rater") == "b").cast("int") + 1), 1, 2, ["subject", "x", "y", "z"], "r")
    c = agreement.overlap(agreement.confusion(pairs, ["subject"], [1], F.lit(8000))).first()
    assert round(c.dice, 6) == 0.677249 and c.tn == 7000


@pytest.mark.parametrize("cells", [None, 0])
def test_distances_are_the_nearest(spark, monkeypatch, cells):
    """Boxes taken whole and cut in layers and slabs: sparse and dense points, negative places, a group with one plane, one without hits."""
    monkeypatch.setattr(distance, "SLAB", 5)
    rng = np.random.default_rng(4)
    spacing = (1.5, 0.7, 2.0)
    groups = {"wide": (rng.integers(-40, 40, (60, 3)), rng.integers(0, 150, (60, 3))), "full": (rng.integers(0, 7, (200, 3)), rng.integers(0, 7, (150, 3))), "flat": (rng.integers(0, 9, (20, 3)) * [1, 1, 0], np.array([[3, 3, 0], [70, 1, 0]])), "none": (np.array([[1, 2, 3]]), np.zeros((0, 3), int)), "far": (np.array([[0, 0, 0]]), np.array([[0, 0, 190]]))}
    rows = [(g, k, *map(int, r)) for g, sides in groups.items() for k, p in enumerate(sides) for r in np.unique(p, axis=0)]
    voxels = spark.createDataFrame(rows, "s string, k int, x int, y int, z int")
    lines = distance.lines(voxels, ["s"], {"a": F.col("k") == 0, "b": F.col("k") == 1})
    got = {(r.s, r.side, r.x, r.y, r.z): r.d for r in distance.nearest(lines, ["s"], spacing, [("a", "b"), ("b", "a")], cells=cells).collect()}
    want = {(g, side, *map(int, p)): np.sqrt((((there - p) * spacing) ** 2).sum(1)).min() for g, pair in groups.items() for side, (here, there) in enumerate((pair, pair[::-1])) for p in here if len(there)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_envelope_is_the_least_of_all_parabolas():
    rng = np.random.default_rng(2)
    f = np.where(rng.random((300, 23)) < 0.4, np.inf, rng.integers(0, 60, (300, 23)) * 0.37)
    f[:3] = np.inf
    i = np.arange(23)
    for step in (1.0, 0.3, 5.0):
        assert np.allclose(distance.envelope(f, step), (f[:, None, :] + (step * (i[:, None] - i)) ** 2).min(2))


def test_shell_over_blocks_of_z(spark):
    """Faces between blocks of 64 places, and below zero."""
    rng = np.random.default_rng(6)
    found = {(int(x), int(y), int(z)) for x, y, z in rng.integers((0, 0, -70), (4, 4, 140), (2500, 3))} | {(i, j, k) for i in range(3) for j in range(3) for k in range(60, 132)}
    df = spark.createDataFrame([("s", *p) for p in found], "s string, x int, y int, z int")
    got = {(r.x, r.y, r.z) for r in surface.shell(df, ["s"]).collect()}
    assert got == {p for p in found if sum(tuple(a + b for a, b in zip(p, d, strict=True)) in found for d in surface.FACES) < 6}


@pytest.mark.parametrize(("points", "six", "twenty_six"), [([], 0, 0), ([(0, 0, 0), (1, 1, 1)], 2, 1), ([(0, 0, 0), (0, 0, 1), (5, 5, 5), (5, 6, 5), (6, 7, 5), (9, 9, 9)], 4, 3)])
def test_components(points, six, twenty_six):
    xyz = np.array(points).reshape(-1, 3)
    assert (topology.n_components(xyz, 6), topology.n_components(xyz, 26)) == (six, twenty_six)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_in_blocks(spark, connectivity):
    """Sparse, dense and winding masks, also across zero, in blocks of several sizes and whole."""
    rng = np.random.default_rng(8)
    snake = [(x, y, 0) for y in range(0, 21, 2) for x in range(-5, 16)] + [((15 if y % 4 == 1 else -5), y, 0) for y in range(1, 20, 2)]
    masks = {"sparse": rng.integers(-9, 12, (700, 3)), "dense": rng.integers(0, 10, (600, 3)), "snake": np.array(snake), "one": np.array([[4, 4, 4]]), "tall": np.array([(0, 0, z) for z in range(-70, 200)])}
    voxels = spark.createDataFrame([(k, 1, *map(int, p)) for k, ps in masks.items() for p in ps], "s string, r int, x int, y int, z int")
    want = {k: topology.n_components(p, connectivity) for k, p in masks.items()}
    assert want["snake"] == want["tall"] == want["one"] == 1 < want["sparse"]
    for most, block in ((None, 128), (0, 4), (300, 3), (0, 100), (0, 1)):
        got = {r.s: r.betti for r in topology.betti0(voxels, ["s", "r"], connectivity, most=most, block=block).collect()}
        assert got == want


def test_diversity_weights(spark):
    small = set(itertools.product(range(10), repeat=3))
    rows = [("s", x * 900 + y * 30 + z, [1, 1, int((x, y, z) in small)]) for x in range(30) for y in range(30) for z in range(30)]
    wide = spark.createDataFrame(rows, "subject string, element int, labels array<int>")
    w = ensemble.diversity_weights(ensemble.pair_dice(wide, ["subject"], 3), ["subject"], 3).first().weights
    assert abs(sum(w) - 1) < 1e-9 and w[2] > w[0] and [round(x, 2) for x in w] == [0.25, 0.25, 0.5]


def test_two_raters_agree_on_the_lower_label(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 5, (1000, 2))
    votes = spark.createDataFrame([("s", i, r + 1, int(x[r])) for i, x in enumerate(labels) for r in (0, 1)], "subject string, element int, rater int, label int")
    elements, _ = ensemble.ensemble(votes, [1, 2])
    assert [r.label for r in elements.orderBy("element").collect()] == labels.min(1).tolist()


def test_probability_ensembles(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(5), (50, 2))
    df = spark.createDataFrame([(i, x.tolist(), [0.3, 0.7]) for i, x in enumerate(p)], "element int, labels array<array<double>>, weights array<double>")
    want = 0.3 * p[:, 0] + 0.7 * p[:, 1]
    for r in ensemble.consensus(df, 2, probabilities=True).collect():
        q = np.clip(want[r.element], 1e-7, 1 - 1e-7)
        assert r.label == want[r.element].argmax() and abs(r.h + (q * np.log2(q)).sum()) < 1e-9
    votes = spark.createDataFrame([("s", 1, 1, 0), ("s", 1, 2, 0)], "subject string, element int, rater int, label int")
    assert abs(ensemble.ensemble(votes, [1, 2])[0].first().h - ensemble.background_entropy()) < 1e-12


def test_clustering_formulas(spark):
    rng = np.random.default_rng(2)
    gt, pred = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    r = agreement.clustering(spark.createDataFrame([("s", int(a), int(b)) for a, b in zip(gt, pred, strict=True)], "s string, gt int, pred int"), ["s"]).first()
    same = lambda v: v[:, None] == v[None]
    off = ~np.eye(200, dtype=bool)
    tp, fn, fp, tn = ((x & y & off).sum() for x, y in ((same(gt), same(pred)), (same(gt), ~same(pred)), (~same(gt), same(pred)), (~same(gt), ~same(pred))))
    assert abs(r.ari - 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))) < 1e-12
    h = lambda *v: -sum(p * np.log2(p) for p in np.unique(np.stack(v), axis=1, return_counts=True)[1] / 200)
    assert abs(r.voi - (2 * h(gt, pred) - h(gt) - h(pred))) < 1e-9


def test_autolabel(spark):
    human = {p: 1 for p in itertools.product(range(5, 15), range(5, 15), range(5, 10))} | {p: 4 for p in itertools.product(range(5, 10), range(5, 10), range(10, 15))}
    cons = {p: 1 for p in itertools.product(range(6, 15), range(6, 15), range(5, 10))} | {p: 4 for p in itertools.product(range(5, 12), range(5, 12), range(10, 15))}
    rows = [("s", human.get(p, 0), cons.get(p, 0)) for p in human.keys() | cons.keys()]
    r = curate.autolabel_stats(spark.createDataFrame(rows, "s string, gt int, pred int"), ["s"]).first()
    assert (r.n_foreground, r.n_ignore, r.pct_ignore) == (625, 95, 15.2)


def test_splits_and_queue(spark):
    audit = spark.createDataFrame([("CLEAN_B", "SUCCESS", "CLEAN_HIGH_CONFIDENCE"), ("CLEAN_A", "SUCCESS", "CLEAN_HIGH_CONFIDENCE"), ("WEAK_A", "SUCCESS", "WEAK_COARSE"), ("REJECT_A", "SUCCESS", "NOISE_REJECT"), ("BAD", "ERROR: boom", None)], "subject_id string, status string, triage_category string")
    assert {r.category: (r.n, r.subject_ids) for r in curate.splits(audit).collect()} == {"CLEAN_HIGH_CONFIDENCE": (2, "CLEAN_A,CLEAN_B"), "WEAK_COARSE": (1, "WEAK_A"), "NOISE_REJECT": (1, "REJECT_A"), "TRAIN_POOL": (3, "CLEAN_A,CLEAN_B,WEAK_A")}
    assert curate.manifest(audit, use_weak=False).count() == 2 and curate.manifest(audit).count() == 3
    pool = spark.createDataFrame([("SUBJ_01", "unlabeled", 0.15, 1), ("SUBJ_02", "triage", 0.85, 2), ("SUBJ_03", "triage", 0.45, 3), ("SUBJ_04", "unlabeled", 0.05, 4)], "subject_id string, state string, score double, seq int")
    assert [r.subject_id for r in curate.review_queue(pool, 2).collect()] == ["SUBJ_02", "SUBJ_03"]
    assert [r.subject_id for r in curate.review_queue(pool.where("state <> 'triage'"), 2).collect()] == ["SUBJ_01", "SUBJ_04"]
    moved = curate.annotated(pool, spark.createDataFrame([("SUBJ_02",), ("SUBJ_02",)], "subject_id string"))
    assert moved.where("subject_id = 'SUBJ_02'").select("state").collect() == [("labeled",)]


@pytest.mark.parametrize(("n", "k"), [(10, 4), (7, 3), (3, 5), (8, 4)])
def test_folds(spark, n, k):
    rows = curate.ranked(spark.range(n), [F.col("id")]).orderBy("id").collect()
    assert [r.rn for r in rows] == list(range(1, n + 1))
    got = [r[0] for r in spark.range(1, n + 1).select(curate.fold_of(F.col("id"), F.lit(n), k)).collect()]
    assert got == [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]


def test_grid_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, (6, 5, 4))
    df = spark.createDataFrame([("s", *map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)], "s string, x int, y int, z int, label int")
    got = {(r.x, r.y, r.z): r.label for r in grid.resize_nearest(df, ["s"], (6, 5, 4), (9, 7, 3)).collect()}
    want = v[np.ix_(np.arange(9) * 6 // 9, np.arange(7) * 5 // 7, np.arange(3) * 4 // 3)]
    assert all(got.get(p, 0) == want[p] for p in np.ndindex(want.shape))
    flipped = {(r.x, r.y, r.z): r.label for r in grid.flip(df, (True, False, True), v.shape).collect()}
    assert all(flipped.get(p, 0) == v[::-1, :, ::-1][p] for p in np.ndindex(v.shape))
    assert grid.best_orientation(df, grid.flip(df, (False, True, True), v.shape), ["s"], v.shape).first().flip == 6
    assert grid.tiles((100, 90, 200)) == [(x, 0, z) for x in (0, 4) for z in (0, 72, 104)]


def test_losses(spark):
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet(np.ones(5), 300), rng.integers(0, 5, 300)
    t[:20] = 255
    df = spark.createDataFrame([(0, x.tolist(), int(y)) for x, y in zip(p, t, strict=True)], "b int, p array<double>, truth int")
    ok = t != 255
    q, y = p[ok], t[ok]
    true = q[np.arange(len(y)), y]
    i, s, g = (np.array([f(c) for c in range(1, 5)]) for f in (lambda c: q[y == c, c].sum(), lambda c: q[:, c].sum(), lambda c: (y == c).sum()))
    assert abs(loss.dice_ce(df, ["b"]).first().loss - (0.5 * -np.log(true).mean() + 0.5 * (1 - 2 * i / (s + g + 1e-6)).mean())) < 1e-9
    ce = (-np.log(true) * np.where(y > 0, 0.7, 1.0)).mean()
    assert abs(loss.asymmetric(df, ["b"]).first().loss - (0.5 * ce + (1 - (2 * i + 1e-5) / (s + g + 1e-5)).mean())) < 1e-9
    wrong = lambda alpha, beta, truth, x: loss.asymmetric_binary(spark.createDataFrame([(0, x, truth)], "b int, p double, truth int"), ["b"], alpha, beta).first().loss
    assert wrong(0.7, 0.3, 1, 0.1) > wrong(0.7, 0.3, 0, 0.9) and wrong(0.3, 0.7, 1, 0.1) < wrong(0.3, 0.7, 0, 0.9)


def test_volumes_round_trip(spark, tmp_path):
    v = np.zeros((4, 3, 2), np.uint8)
    v[1, 2, 0], v[3, 0, 1] = 3, 255
    affine = np.diag([1.5, 1.5, 2.0, 1.0])
    (tmp_path / "a.nii.gz").write_bytes(volumes.encode_nifti(v, affine))
    (tmp_path / "broken.nii.gz").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    r = got["a.nii.gz"]
    assert r.status == "SUCCESS" and r.shape == [4, 3, 2] and [round(x, 4) for x in r.spacing] == [1.5, 1.5, 2.0] and got["broken.nii.gz"].status.startswith("ERROR")
    assert {tuple(x)[1:] for x in volumes.voxels(volumes.read_volumes(spark, str(tmp_path))).collect()} == {(1, 2, 0, 3), (3, 0, 1, 255)}
    head = b"NRRD0004\ntype: uint8\ndimension: 3\nsizes: 4 3 2\nspace directions: (1.5,0,0) (0,1.5,0) (0,0,2)\nencoding: raw\n\n"
    (tmp_path / "b.seg.nrrd").write_bytes(head + v.tobytes(order="F"))
    n = volumes.read_volumes(spark, str(tmp_path), "*.nrrd").first()
    assert n.spacing == [1.5, 1.5, 2.0] and sorted(n.label) == [3, 255]
    np.savez(tmp_path / "p.npz", probs=np.random.default_rng(0).random((5, 2, 2, 3)).astype(np.float16))
    assert volumes.read_probabilities(spark, str(tmp_path)).count() == 12


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("00242113", 0.5), ("1", None)], "subject_id string, score double")
    tables.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/csv", df.schema).collect()} == {("00242113", 0.5), ("1", None)}
    (tmp_path / "list.txt").write_text("b\n\n  a \n")
    assert [r[0] for r in tables.read_list(spark, f"{tmp_path}/list.txt").collect()] == ["b", "a"]
    merged = tables.merged_shards(spark.createDataFrame([("s", 1, "f2"), ("s", 2, "f1"), ("t", 3, "f2")], "subject_id string, v int, file string"))
    assert {tuple(r) for r in merged.collect()} == {("s", 2), ("t", 3)}


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.7, 2), ("a", 0.7, 3), (None, 0.1, 4)], "k string, v double, e int")
    assert {tuple(r) for r in report.value_counts(df, "k").collect()} == {("a", 3, 75.0)}
    assert report.best_rows(df.where("k = 'a'"), ["k"], "v", "e").first().e == 2
    assert [r.e for r in report.improved(df.where("k = 'a'"), ["k"], "v", "e", 0.0).orderBy("e").collect()] == [1, 2]


def test_listing(spark, tmp_path):
    (tmp_path / "P1").mkdir()
    (tmp_path / "P1" / "ct.nii.gz").write_bytes(b"x")
    r = files.listing(spark, str(tmp_path)).first()
    assert (r["name"], r["folder"], r["size"]) == ("ct.nii.gz", "P1", 1)


def test_sources_read_headers_only(spark, tmp_path):
    """Rows by subject, pushed conditions, a payload that isn't there, a broken header, more files than a partition takes."""
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith
    from pyspark.sql.types import StructType

    data = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    affine = np.array([[0.0, -2, 0, 5], [1.5, 0, 0, 6], [0, 0, 3, 7], [0, 0, 0, 1]])
    (tmp_path / "sub").mkdir()
    whole, nrrd = volumes.encode_nifti(data, affine), volumes.encode_nrrd(data, (1.0, 2.0, 3.0))
    for name, raw in {"A1.nii.gz": whole, "A2.nii.gz": whole, "sub/B1.nii.gz": whole, "cut.nii.gz": whole[:-12], "bad.nii.gz": whole[:30], "none.nii.gz": b"", "n.nrrd": nrrd, "ncut.nrrd": nrrd[:-5]}.items():
        (tmp_path / name).write_bytes(raw)
    formats.register(spark)
    heads = spark.read.format("nifti").schema("subject string, status string, shape array<int>, affine array<double>").option("partitionBytes", len(whole)).load(f"file://{tmp_path}")
    assert heads.rdd.getNumPartitions() >= 3
    got = {r.subject: r for r in heads.collect()}
    assert {s for s, r in got.items() if r.status == "SUCCESS"} == {"A1", "A2", "B1", "cut"} and got.keys() == {"A1", "A2", "B1", "cut", "bad", "none"}
    assert got["cut"].shape == [2, 3, 4] and np.allclose(got["cut"].affine, affine.ravel()) and got["bad"].shape is None
    full = {r.subject: r for r in spark.read.format("nifti").load(str(tmp_path)).collect()}
    assert full["cut"].status.startswith("ERROR") and full["A1"].label == list(range(1, 24)) and full["A1"].x[0] == 0
    assert [r.subject for r in heads.where("subject = 'B1'").collect()] == ["B1"]
    assert sorted(r.subject for r in heads.where("subject like 'A%' and status = 'SUCCESS'").collect()) == ["A1", "A2"]
    reader = formats.Nifti({"path": str(tmp_path)}).reader(StructType().add("subject", "string"))
    assert list(reader.pushFilters([EqualTo(("status",), "x"), In(("subject",), ("A1", "B1")), StringStartsWith(("subject",), "A")])) == [EqualTo(("status",), "x")]
    assert [p.rsplit("/", 1)[-1] for part in reader.partitions() for p in part.paths] == ["A1.nii.gz"]
    n = {r.subject: r for r in spark.read.format("nrrd").schema("subject string, status string, spacing array<double>").load(str(tmp_path)).collect()}
    assert n["n"].spacing == n["ncut"].spacing == [1.0, 2.0, 3.0] and n["ncut"].status == "SUCCESS"
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("nifti").schema("subjct string").load(str(tmp_path)).collect()


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_quantiles_by_counting(spark, sent):
    """Ties, one value, infinities apart, tiny and huge spreads, nulls and NaN, against numpy; groups sent to all tasks, and joined."""
    rng = np.random.default_rng(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    groups = {"many": rng.normal(0, 1e6, 3000), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(50, -3.0), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0]), "narrow": 1 + rng.integers(0, 9, 200) * 2.0**-52, "scales": 2.0 ** rng.integers(-60, 60, 400)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for bins in (256, 2) if sent else (256,):
        got = {r.g: r.quantiles for r in quantiles(df.where("g <> 'scales'") if bins == 2 else df, ["g"], "v", probs, bins=bins, sent=sent).collect()}
        assert got.keys() == groups.keys() - ({"scales"} if bins == 2 else set())
        for k, v in got.items():
            if k != "wide":
                assert np.allclose(v, np.quantile(groups[k], probs), rtol=1e-12, atol=0)
        assert got["wide"][0] == -1.7e308 and got["wide"][3] == 1.0 and got["wide"][5] == 1.7e308
        if bins == 2:
            break


def test_grids_in_the_worlds_order():
    """Spacing and directions of the new grid, corners, and the axes' order against the map's effect."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        a = np.eye(4)
        a[:3, :3], a[:3, 3] = turn * rng.uniform(0.5, 3, 3), rng.normal(0, 9, 3)
        shape = tuple(int(n) for n in rng.integers(1, 30, 3))
        o = respace.ordered(a, shape)
        assert all(o.affine[w, w] > 0 or abs(o.affine[w, w]) <= 0.8 * np.linalg.norm(o.affine[:3, w]) for w in range(3)) and sorted(o.shape) == sorted(shape)
        for upright in (False, True):
            t = respace.respaced(a, shape, (1.5, 1.5, 2.0), upright)
            assert np.allclose(np.linalg.norm(t.affine[:3, :3], axis=0), (1.5, 1.5, 2.0)) and np.allclose(a[:3] @ np.vstack([t.matrix, [0, 0, 0, 1]]), t.affine[:3])
            if not upright:
                assert np.allclose(t.affine[:3, 3], o.affine[:3, 3]) and all(abs((m - 1) * s - (n - 1) * d) <= s / 2 + 1e-6 for m, s, n, d in zip(t.shape, (1.5, 1.5, 2.0), o.shape, np.linalg.norm(o.affine[:3, :3], axis=0), strict=True))
    same = respace.respaced(np.diag([1.5, 1.5, 2.0, 1]), (5, 6, 7), (1.5, 1.5, 2.0))
    assert same.shape == (5, 6, 7) and np.allclose(same.matrix, np.eye(4)[:3])


def test_resampling_in_blocks(spark):
    """A general map over several blocks and tiles against one array, with border places and voxels that aren't stored."""
    rng = np.random.default_rng(3)
    shape, target = (9, 7, 8), (8, 6, 10)
    image, label = rng.normal(size=shape), rng.integers(0, 5, shape)
    image[rng.random(shape) < 0.1] = 0
    m = np.array([[0.9137, 0.3071, -0.1053, 0.4019], [-0.2043, 1.1159, 0.2517, 0.3011], [0.1039, -0.1523, 0.8087, -0.7013]])
    voxels = spark.createDataFrame([("s", *map(int, p), float(image[p]), int(label[p])) for p in np.ndindex(shape) if image[p] or label[p]], "s string, x int, y int, z int, value double, label int")
    grids = spark.createDataFrame([("s", m.ravel().tolist(), list(target), list(shape))], "s string, matrix array<double>, shape array<int>, source array<int>")
    for block, tile in ((32, 32), (4, 3), (3, 5), (1, 2)):
        got = {(r.x, r.y, r.z): (r.value, r.label) for r in respace.resampled(voxels, grids, ["s"], block=block, tile=tile).collect()}
        assert len(got) == np.prod(target)
        for p in np.ndindex(target):
            q = np.clip(m[:, :3] @ p + m[:, 3], 0, np.array(shape) - 1)
            low = np.floor(q).astype(int)
            want = sum(np.prod(np.where(c, q - low, 1 - q + low)) * image[tuple(np.minimum(low + c, np.array(shape) - 1))] for c in map(np.array, np.ndindex(2, 2, 2)))
            assert abs(got[p][0] - want) < 1e-9 and got[p][1] == label[tuple(np.floor(q + 0.5).astype(int))]


def test_windows_with_a_halo(spark):
    """A function of the neighbourhood, blended from windows with a halo, is that of the whole; scans smaller than a window too."""
    rng = np.random.default_rng(4)
    images = {"a": rng.normal(size=(11, 5, 7)), "small": rng.normal(size=(2, 3, 2))}
    voxels = spark.createDataFrame([(s, *map(int, p), float(a[p])) for s, a in images.items() for p in np.ndindex(a.shape)], "s string, x int, y int, z int, value double")
    scans = spark.createDataFrame([(s, list(a.shape)) for s, a in images.items()], "s string, shape array<int>")

    def around(block):  # the sum of a place and its six neighbours
        c = block[1:-1, 1:-1, 1:-1]
        return c + block[2:, 1:-1, 1:-1] + block[:-2, 1:-1, 1:-1] + block[1:-1, 2:, 1:-1] + block[1:-1, :-2, 1:-1] + block[1:-1, 1:-1, 2:] + block[1:-1, 1:-1, :-2]

    for size, overlap in ((4, 0.25), (4, 0.5), (3, 0.0)):
        out = windows.applied(windows.cut(voxels, scans, ["s"], size=size, overlap=overlap, halo=1), around, ["s"], size=size, halo=1)
        for kind in ("constant", "gaussian"):
            got = {(r.s, r.x, r.y, r.z): r.v for r in windows.blended(out, ["s"], size=size, kind=kind).collect()}
            assert len(got) == sum(a.size for a in images.values())
            for s, a in images.items():
                want = around(np.pad(a, 1))
                assert all(abs(got[(s, *p)] - want[p]) < 1e-9 for p in np.ndindex(a.shape))


def test_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver lists sub-folders alone; small scans share Arrow batches, also where a batch cuts a scan."""
    from tallyvox.sources import volumes

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        v = spark.range(300).selectExpr("id AS s", "explode(sequence(0, CAST(id % 5 AS INT))) AS x").selectExpr("s", "x", "1 AS y", "2 AS z", "CAST(s % 4 + 1 AS INT) AS label")
        files = volumes.encoded(v, "s", (5, 2, 3), suffix=".nii.gz")
        assert "FlatMapGroups" not in files._jdf.queryExecution().executedPlan().toString()
        assert volumes.exported(files, f"file://{tmp_path}/v", 8).count() == 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = volumes.contents(spark, f"file://{tmp_path}/v", ".nii.gz")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and sorted(x.name for x in (tmp_path / "v").iterdir()) == [f"{i:05d}" for i in range(8)]
    got = {(int(r.path.rsplit("/", 1)[1].split(".")[0]), r.x, r.y, r.z, r.label) for r in volumes.voxels(volumes.decoded(found)).collect()}
    assert got == {tuple(r) for r in v.collect()}
    p = spark.range(40).selectExpr("id AS s", "0 AS x", "1 AS y", "0 AS z", "array(0.5F, CAST(id % 3 AS FLOAT)) AS p")
    volumes.exported(volumes.encoded_probabilities(p, "s", (1, 2, 1), 2), f"file://{tmp_path}/p", 4).count()
    back = volumes.decoded_probabilities(volumes.contents(spark, f"file://{tmp_path}/p", ".npz")).where("y = 1").selectExpr("regexp_extract(path, '([0-9]+)_', 1)", "p[0]", "p[1]").collect()
    assert {tuple(r) for r in back} == {(str(i), 0.5, float(i % 3)) for i in range(40)}


def test_source_listed_by_tasks(spark, tmp_path):
    """With listing `tasks` a partition is a sub-folder; conditions on the subject hold there too."""
    from tallyvox.sources import formats, volumes

    formats.register(spark)
    v = spark.range(60).selectExpr("id AS s", "0 AS x", "1 AS y", "2 AS z", "3 AS label")
    volumes.exported(volumes.encoded(v, "s", (1, 2, 3), suffix=".nrrd"), f"file://{tmp_path}/v", 4).count()
    rows = spark.read.format("nrrd").option("listing", "tasks").load(f"file://{tmp_path}/v")
    assert rows.rdd.getNumPartitions() == 4 and {r.subject for r in rows.collect()} == {str(i) for i in range(60)}
    assert [r.label for r in rows.where("subject = '7'").collect()] == [[3]]
    assert spark.read.format("nrrd").option("listing", "tasks").load(f"file://{tmp_path}/none").count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_never_broadcast(spark):
    """Their sizes are guessed from the few rows they are made of; at 1 GB they filled the driver."""
    from tallyvox.plans import catalog

    for name in ("g02_g07_resample_affine", "g06_foreground_crop_pad", "m43_orientation", "s17_merged_organs", "g03_resize_linear", "g07_g03_upright", "g07_g03_respaced", "g05_crop", "g10_windows_blended"):
        assert "Broadcast" not in _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name
    for name in ("m43_orientation", "s17_merged_organs", "g03_resize_linear"):
        assert "Join" not in _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_orientation_by_orbits(spark):
    """On a grid with a middle plane, whose voxels are alike under a flip, against all eight flips."""
    from tallyvox.operators import grid

    rng, shape = np.random.default_rng(3), (5, 4, 3)
    rows = {side: [(s, *map(int, p), int(rng.integers(1, 4))) for s in range(6) for p in np.argwhere(rng.random(shape) < 0.5)] for side in ("gt", "pred")}
    gt, pred = (spark.createDataFrame(rows[k], "s int, x int, y int, z int, label int") for k in ("gt", "pred"))
    for r in grid.best_orientation(gt, pred, ["s"], shape).collect():
        at = {side: {x[1:4]: x[4] for x in rows[side] if x[0] == r.s} for side in rows}
        n = {k: sum(v == k for side in at.values() for v in side.values()) for k in (1, 2, 3)}
        scores = []
        for f in range(8):
            moved = {tuple(m - 1 - c if f >> b & 1 else c for b, (c, m) in enumerate(zip(p, shape, strict=True))): v for p, v in at["pred"].items()}
            scores.append(round(sum(2 * sum(at["gt"].get(p) == v == k for p, v in moved.items()) / n[k] for k in n if n[k]), 9))
        assert (r.flip, round(r.score, 9)) == (scores.index(max(scores)), max(scores))


def test_few_rows_are_dealt_out(spark):
    """Suppliers and parts come as one small file; the voxels made of them are spread over all partitions."""
    from tallyvox.plans import catalog

    for name in ("s16_synthetic_cohort", "g10_windows_blended", "g03_resize_linear", "g07_g03_respaced"):
        assert "REPARTITION_BY_NUM" in _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")), name
    assert _plan(catalog.QUERIES["g10_windows_blended"](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1].count("MapInArrow") == 1


def test_batches_lie_many_to_a_folder(spark, tmp_path):
    from tallyvox.sources import tables

    at = f"{tmp_path}/c"
    rows = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id", f"{v} AS v")
    tables.checkpoint(rows(0, 3001, 0), at, "id", every=2)
    tables.checkpoint(rows(0, 4, 1), at, "id", every=2, start=1)  # batches 1 and 2 anew, the others of their folder stay
    assert sorted(x.name for x in (tmp_path / "c").iterdir() if x.is_dir()) == ["folder=0", "folder=1"]
    got = {(r.id, r.v, r.batch) for r in spark.read.parquet(at).collect()}
    assert got == {(i, 0, i // 2) for i in range(3001) if i // 2 not in (1, 2)} | {(i, 1, 1 + i // 2) for i in range(4)}
    at = f"{tmp_path}/u"
    tables.checkpoint(rows(0, 2101, 0), at, "id", every=2)
    for _ in range(2):  # a repeated run changes nothing
        tables.upsert(spark, at, rows(2000, 2104, 5), "id", every=2)
        got = {(r.id, r.v, r.batch) for r in spark.read.parquet(at).collect()}
        assert got == {(i, 5 if i >= 2000 else 0, i // 2 if i < 2101 else 1051 + (i - 2101) // 2) for i in range(2104)}


def test_scans_are_unpacked_a_few_at_a_time():
    """An Arrow batch holds up to 10,000 scans, whose places aren't all in memory at once."""
    import pyarrow as pa

    from tallyvox.operators import distance

    line = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("zb", pa.int32()), ("gt", pa.int64()), ("pred", pa.int64())])
    own = [[{"x": 0, "y": i, "zb": 0, "gt": 7, "pred": -1} for i in range(n)] for n in (1, 1, 3, 0, 9, 1)]
    rows = pa.record_batch([pa.array(range(6)), pa.array(own, pa.list_(line))], names=["s", "lines"])
    got = [x.column("s").to_pylist() for x in distance.few(rows, 140)]
    assert got == [[0, 1], [2], [3], [4], [5]] and [x.num_rows for x in distance.few(rows, 10**6)] == [6]


def test_blocks_meet_in_a_task_or_as_a_graph(spark):
    """Random masks cut into small blocks, negative places and more than one line of 64 places too: as whole, both ways."""
    from tallyvox.operators import topology

    rng = np.random.default_rng(5)
    rows = [(s, *(int(c) - 3 for c in p)) for s in range(4) for p in np.argwhere(rng.random((7, 6, 140)) < 0.12 + 0.05 * s)]
    v = spark.createDataFrame(rows, "s int, x int, y int, z int")
    for connectivity in (6, 26):
        want = {r.s: r.betti for r in topology.betti0(v, ["s"], connectivity).collect()}
        for links in (None, 0):
            for block in (3, 80):
                assert {r.s: r.betti for r in topology.betti0(v, ["s"], connectivity, most=0, block=block, links=links).collect()} == want


def test_blocks_are_cut_from_lines(spark, monkeypatch):
    """Lines are cut to blocks as they are: taken apart by voxel they were shuffled twice, and links of few voxels many times."""
    from tallyvox.operators import topology

    monkeypatch.setattr(topology, "links_contracted", None)  # not asked for where blocks share few voxels
    v = spark.range(3).selectExpr("id AS s", "explode(sequence(0, 9)) AS x").selectExpr("s", "x", "x AS y", "x AS z")
    assert {r.betti for r in topology.betti0(v, ["s"], 26, most=0, block=4).collect()} == {1}


def test_resampled_places_are_not_moved(spark):
    """Each place of each target grid was shuffled and sorted to meet the sources; now parts alone are, as they are dealt out."""
    from tallyvox.plans import catalog

    plan = _plan(catalog.QUERIES["g02_g07_resample_affine"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") > 0


TURN = [[0.9 * np.cos(0.5), -0.9 * np.sin(0.5), 0.1], [1.1 * np.sin(0.5), 1.1 * np.cos(0.5), -0.2], [0.05, 0.15, 1.3]]


@pytest.mark.parametrize(
    ("matrix", "offset"),
    [
        ([[2.0, 0, 0], [0, -1.0, 0], [0, 0, 1.4]], [0.25, 4.0, 0.1]), ([[0, 0, -0.5], [0.25, 0, 0], [0, 1.5, 0]], [3.0, 0.0, -1.5]), (TURN, [0.3, -1.7, 0.2]),
        ([[1, 0, 0], [0, 1, 0], [0, 0, 0]], [0.0, 0.0, 2.0]), ([[0.5, 0.5, 0], [0.5, 0.5, 0], [0, 0, 1]], [0.0, 0.0, 0.0]), ([[0, 0, 0], [0, 0, 0], [0, 0, 0]], [1.0, 1.0, 1.0]),
    ],
)
@pytest.mark.parametrize("tile", [7, 4096])
def test_affine_resampling(spark, matrix, offset, tile):
    """Flipped, enlarged, turned and flat maps, halves and places below zero; two voxels at a place, one without a label, groups without voxels, not asked for or null."""
    rng, target = np.random.default_rng(7), (5, 6, 4)
    rows = [(s, *(int(c) - 1 for c in p), int(rng.integers(1, 5))) for s in (0, 1, 9, None) for p in np.argwhere(rng.random((6, 7, 6)) < 0.6)] + [(0, 1, 1, 2, 8), (0, 1, 1, 2, 9), (1, 1, 1, 1, None)]
    v = spark.createDataFrame(rows, "s int, x int, y int, z int, label int")
    groups = spark.createDataFrame([(0,), (1,), (2,), (None,)], "s int")
    want = []
    for s in (0, 1, 2, None):
        for t in np.ndindex(*target):
            at = [offset[r] + t[0] * matrix[r][0] + t[1] * matrix[r][1] + t[2] * matrix[r][2] for r in range(3)]
            here = tuple(int(np.sign(a) * np.floor(abs(a) + 0.5)) for a in at)
            want += [(s, *t, x) for x in [r[4] or 0 for r in rows if s is not None and r[:4] == (s, *here)] or [0]]
    order = lambda r: tuple(-1 if c is None else c for c in r)
    got = grid.resample_affine(v, groups, ["s"], matrix, offset, target, tile=tile)
    assert got.dtypes == [(c, "int") for c in ("s", "x", "y", "z", "label")]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
