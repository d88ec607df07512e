"""Scalar rules and metrics on fixed vectors."""

import math

import pytest
from pyspark.sql import functions as F

from tallyvox.functions import metrics, rules
from tallyvox.functions.metrics import Empty

N = rules.NOISE
TRIAGE = [
    (0.95, 0.95, 6, 0.0, N), (0.49, 0.99, 0, 0.0, N), (0.95, 0.95, 0, 0.16, N), (0.82, 0.85, 2, 0.05, rules.CLEAN), (0.83, 0.80, 1, 0.05, rules.WEAK), (0.70, 0.90, 0, 0.05, rules.WEAK),
    (0.82, 0.85, 2, 0.15, rules.CLEAN), (0.50, 0.99, 0, 0.0, rules.WEAK), (0.9, 0.9, 5, 0.0, rules.WEAK), (0.9, 0.9, 6, 0.0, N), (0.9, 0.9, 2, 0.0, rules.CLEAN), (0.9, 0.9, 3, 0.0, rules.WEAK), (0.99, 0.99, 99, 0.0, N),
    (0.9, 0.9, 0, None, rules.CLEAN), (None, 0.9, 0, 0.0, rules.WEAK),
]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").orderBy("_i").select(*columns).collect()]


def test_triage(spark):
    got = values(spark, [r[:4] for r in TRIAGE], "d double, i double, b int, h double", rules.triage(F.col("d"), F.col("i"), F.col("b"), F.col("h")).alias("c"), rules.action(rules.triage(F.col("d"), F.col("i"), F.col("b"), F.col("h"))))
    assert got == [(r[4], rules.ACTIONS[r[4]]) for r in TRIAGE]


def test_legacy_triage_and_outcome(spark):
    got = values(spark, [(0.9, 0), (0.9, 6), (0.4, 0), (0.7, 0), (None, 0)], "d double, b int", rules.legacy_triage(F.col("d"), F.col("b")))
    assert [r[0] for r in got] == [rules.CLEAN, rules.LEGACY_REJECT, rules.LEGACY_REJECT, rules.WEAK, rules.WEAK]
    assert [r[0] for r in values(spark, [(0.9, 0.01), (0.9, 0.05), (0.6, 0.0)], "m double, r double", rules.outcome(F.col("m"), F.col("r")))] == ["A", "B", "C"]


def test_winner_and_composite(spark):
    got = values(spark, [(None, None), (None, 0.1), (0.1, None), (0.5, 0.506), (0.506, 0.5), (0.5, 0.504)], "a double, b double", rules.winner(F.col("a"), F.col("b"), ("Swin", "MedNeXt")))
    assert [r[0] for r in got] == ["N/A", "MedNeXt", "Swin", "MedNeXt", "Swin", "Tie"]
    got = values(spark, [(1.0, 0.0), (1.0, None), (0.5, 25.0), (0.5, 80.0)], "d double, h double", rules.composite(F.col("d"), F.col("h")))
    assert [round(r[0], 9) for r in got] == [1.0, 0.4, 0.5, 0.2]


def test_entropy(spark):
    got = values(spark, [([0.2] * 5,), ([1.0, 0.0, 0.0, 0.0],), ([0.5, 0.5, 0.0, 0.0],), ([0.5],)], "p array<double>", rules.entropy(F.col("p")))
    assert abs(got[0][0] - math.log2(5)) < 1e-3 and got[1][0] < 1e-4 and got[2][0] > 0.5 and abs(got[3][0] - 1) < 1e-6


def test_softmax_argmax_one_hot(spark):
    got = values(spark, [([1.0, 3.0, 3.0],), ([1e4, -1e4, 0.0],)], "z array<double>", rules.softmax(F.col("z")), rules.top_class(F.col("z")), rules.one_hot(rules.top_class(F.col("z")), 3))
    assert abs(sum(got[0][0]) - 1) < 1e-12 and got[0][1:] == (1, [0, 1, 0]) and got[1][0] == [1.0, 0.0, 0.0] and got[1][1] == 0


def test_names(spark):
    got = values(spark, [("BDMAP_00242113_gi_seg.nii.gz",), ("x_gi_mask.nii.gz",), ("A_seg.nii.gz",), ("B.nii.gz",), ("none12345",)], "n string", rules.subject_of(F.col("n")), rules.numeric_key(F.col("n")))
    assert got == [("BDMAP_00242113", "00242113"), ("x", None), ("A", None), ("B", None), ("none12345", None)]


@pytest.mark.parametrize(("empty", "want"), [(Empty.ONE, 1.0), (Empty.NULL, None), (Empty.ZERO, 0.0)])
def test_empty_policies(spark, empty, want):
    t = [F.col(c) for c in ("tp", "fp", "fn")]
    got = values(spark, [(0, 0, 0), (0, 2, 0), (2, 1, 1)], "tp int, fp int, fn int", metrics.dice(*t, empty), metrics.iou(*t, empty))
    assert got == [(want, want), (0.0, 0.0), (4 / 6, 0.5)]


def test_undefined_ratios(spark):
    t = [F.col(c) for c in ("tp", "fp", "fn")]
    got = values(spark, [(0, 0, 0), (0, 2, 0), (0, 0, 3)], "tp int, fp int, fn int", metrics.precision(*t), metrics.sensitivity(*t), metrics.rvd(*t), metrics.voe(*t))
    assert got == [(1.0, 1.0, 0.0, 0.0), (0.0, 0.0, None, 1.0), (0.0, 0.0, -1.0, 1.0)]


def test_remaps_and_windows(spark):
    got = values(spark, [(57, 1), (57, 9), (20, 1), (20, 9), (6, 0), (300, 0)], "l int, z int", rules.remap(F.col("l"), rules.FULL_BODY), rules.remap_split(F.col("l"), F.col("z"), F.lit(14), "TotalSegmentator"), rules.clamp_label(F.col("l")))
    assert got == [(3, 6, 0), (3, 6, 0), (3, 4, 0), (3, 5, 0), (4, 0, 0), (0, 0, 0)]
    assert [r[0] for r in values(spark, [(-500.0,), (37.5,), (999.0,)], "h double", rules.window_intensity(F.col("h")))] == [0.0, 0.5, 1.0]
