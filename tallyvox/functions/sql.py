"""The scalar rules and the decoding of volumes as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import volumes
from . import rules

FUNCTIONS = {
    "triage_case(d DOUBLE, i DOUBLE, b INT, h DOUBLE) RETURNS STRING": f"CASE WHEN b > {rules.NOISE_BETTI_DIFF_MAX} OR d < {rules.NOISE_DICE_MIN}D OR h > {rules.NOISE_UNCERTAINTY_MAX}D THEN '{rules.NOISE}' WHEN d >= {rules.CLEAN_DICE_MIN}D AND i >= {rules.CLEAN_INTER_MIN}D AND b <= {rules.CLEAN_BETTI_DIFF_MAX} THEN '{rules.CLEAN}' ELSE '{rules.WEAK}' END",
    "dice(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2D * tp / (2 * tp + fp + fn) ELSE 1D END",
    "iou(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE": "CASE WHEN tp + fp + fn > 0 THEN 1D * tp / (tp + fp + fn) ELSE 1D END",
    "composite_score(d DOUBLE, hd DOUBLE) RETURNS DOUBLE": "0.4D * d + 0.6D * coalesce(greatest(0D, 1D - hd / 50D), 0D)",
    "autolabel(human INT, consensus INT) RETURNS INT": f"CASE WHEN human > 0 AND human <> consensus THEN {rules.IGNORE} ELSE human END",
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions; Catalyst inlines them, so they cost no call."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def _foreground(path: str, raw: bytes) -> tuple[np.ndarray, ...] | None:
    try:
        label = volumes.labels((volumes.decode_nrrd if path.endswith(".nrrd") else volumes.decode_nifti)(raw)[0])
    except Exception:  # a bad file gives no voxels; `status` of the readers says why
        return None
    at = np.nonzero(label)
    return (*(a.astype(np.int32) for a in at), label[at])


class DecodeVolume:
    """decode_volume(path, content), for LATERAL: the foreground voxels of a file as rows; none for one that can't be read. Spark has no lateral join with Arrow table functions, so rows go one by one."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        found = _foreground(path, content)
        if found is not None:
            yield from zip(*(a.tolist() for a in found), strict=True)


class DecodeVolumes:
    """decode_volumes(TABLE(path, content)): the same for a table of files, in Arrow batches, with the path."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
        for path, raw in zip(files.column("path"), files.column("content"), strict=True):
            found = _foreground(path.as_py(), raw.as_py())
            if found is not None:
                yield pa.table({"path": pa.array([path.as_py()] * len(found[3]), pa.string())} | {c: pa.array(a) for c, a in zip(["x", "y", "z", "label"], found, strict=True)})


def register_tables(spark: SparkSession) -> None:
    """Table functions."""
    spark.udtf.register("decode_volume", F.udtf(DecodeVolume, returnType="x int, y int, z int, label short"))
    spark.udtf.register("decode_volumes", F.arrow_udtf(DecodeVolumes, returnType="path string, x int, y int, z int, label short"))
