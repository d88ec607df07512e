"""Agreement measures from counts, with the empty case as a named policy."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Empty(Enum):
    """What a ratio is where its denominator is 0."""

    ONE = 1.0
    NULL = None
    ZERO = 0.0


def ratio(num: Column, den: Column, empty: Empty) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty.value).cast("double"))


def dice(tp: Column, fp: Column, fn: Column, empty: Empty = Empty.ONE) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, empty)


def dice_smoothed(tp: Column, fp: Column, fn: Column) -> Column:
    """2i / (u + 1e-6): 0 where both are empty."""
    return 2 * tp / (2 * tp + fp + fn + F.lit(1e-6))


def iou(tp: Column, fp: Column, fn: Column, empty: Empty = Empty.ONE) -> Column:
    return ratio(tp, tp + fp + fn, empty)


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """1 where both are empty, 0 where only the prediction is."""
    return F.when(tp + fp + fn == 0, 1.0).otherwise(ratio(tp, tp + fp, Empty.ZERO))


def sensitivity(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(ratio(tp, tp + fn, Empty.ZERO))


def specificity(tn: Column, fp: Column) -> Column:
    return ratio(tn, tn + fp, Empty.ONE)


def voe(tp: Column, fp: Column, fn: Column) -> Column:
    return 1 - iou(tp, fp, fn)


def rvd(tp: Column, fp: Column, fn: Column) -> Column:
    """(v_pred - v_gt) / v_gt: 0 where both are empty, null where only the truth is."""
    return F.when(tp + fp + fn == 0, 0.0).otherwise(ratio(fp - fn, tp + fn, Empty.NULL))


def volume_ml(voxels: Column, spacing: tuple[float, float, float]) -> Column:
    return voxels * (spacing[0] * spacing[1] * spacing[2] / 1000)
