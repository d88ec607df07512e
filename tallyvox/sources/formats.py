"""NIfTI and NRRD as data sources of Spark: spark.read.format("nifti").load(folder).

A partition is a group of files of about `partitionBytes` (64 MB). Rows have path, subject, status, shape, spacing, affine and the
foreground voxels as arrays (x, y, z, label). With a schema of fewer columns only those are made; without a voxel column only the
header is read, and nothing behind it is inflated. Conditions on the subject (=, IN, IN a prefix) and on the path's end choose
files before any is opened. A file that can't be read is a row with its error as status.

Options: path, suffix (.nii.gz; .nrrd), partitionBytes, listing. With listing `tasks` the files lie in sub-folders of the path, the
driver lists these alone, and each is a partition whose task lists its files: for folders of millions of files. A folder is searched with its subfolders, by a store that pyarrow opens;
`volumes.read_volumes()` reads any store that Spark reads.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from . import volumes
from .volumes import store_of

COLUMNS = "path string, subject string, status string, shape array<int>, spacing array<double>, affine array<double>, x array<int>, y array<int>, z array<int>, label array<short>"
VOXELS = {"x", "y", "z", "label"}


def infos(folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change in ns) of the files below a folder, or of one file."""
    from pyarrow import fs

    store, base = store_of(folder)
    found = store.get_file_info(base)
    if found.type == fs.FileType.File:
        return [(folder, found.size, found.mtime_ns)]
    head = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    rows = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((head + f.path, f.size, f.mtime_ns) for f in rows if f.type == fs.FileType.File and f.path.endswith(suffix))


class Files(InputPartition):
    """Files, or a folder that its task lists."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, suffix: str, header, decode):
        self.names, self.suffix, self.header, self.decode = schema.names, options.get("suffix", suffix), header, decode
        known = [c.split()[0] for c in COLUMNS.split(", ")]
        if unknown := set(self.names) - set(known):
            raise ValueError(f"no such columns: {sorted(unknown)}; there are {known}")
        if not options.get("path"):
            raise ValueError("the option path is missing: load(folder)")
        self.folder, self.size = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        if (listing := options.get("listing", "driver")) not in ("driver", "tasks"):
            raise ValueError(f"no such listing: {listing}; there are driver and tasks")
        self.by_tasks = listing == "tasks"
        self.types = {f.name: _arrow(f.dataType) for f in schema.fields}
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("subject",):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        s = self.subject(path)
        return all({"EqualTo": lambda v: s == v, "In": lambda v: s in v, "StringStartsWith": s.startswith}[kind](value) for kind, value in self.tests)

    def subject(self, path: str) -> str:
        return path.rsplit("/", 1)[-1].removesuffix(self.suffix)

    def partitions(self) -> list[Files]:
        if self.by_tasks:
            return [Files([], sub) for sub in volumes.subfolders(self.folder)] or [Files([])]
        groups, held = [], self.size
        for path, size, _ in infos(self.folder, self.suffix):
            if self.wanted(path):
                if held + size > self.size:
                    groups.append([])
                    held = 0
                groups[-1].append(path)
                held += size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        found = partition.paths if partition.folder is None else filter(self.wanted, volumes.listed(partition.folder, self.suffix))
        return volumes.together(map(self.row, found), {c: self.types[c] for c in self.names})

    def row(self, path: str) -> dict:
        row = {c: None for c in VOXELS | {"shape", "spacing", "affine"}} | {"path": path, "subject": self.subject(path)}
        try:
            return row | self.values(path) | {"status": "SUCCESS"}
        except Exception as e:  # a bad file is a row with its error, and the others go on
            return row | {"status": f"ERROR: {e}"[:200]}

    def values(self, path: str) -> dict:
        store, base = store_of(path)
        with store.open_input_stream(base, compression=None) as raw:
            if not VOXELS & set(self.names):
                head = self.header(raw)
                return {"shape": list(head.shape), "spacing": head.spacing, "affine": head.affine.ravel().tolist()}
            data, spacing, affine = self.decode(raw.read())
        label = volumes.labels(data)
        at = np.nonzero(label)
        return {"shape": list(data.shape), "spacing": spacing, "affine": affine.ravel().tolist(), "label": label[at]} | {c: a.astype(np.int32) for c, a in zip("xyz", at, strict=True)}


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _nifti_header(raw) -> volumes.Header:
    start = raw.read(2)
    rest = volumes.NIFTI_HEADER - 2
    return volumes.nifti_header(gzip.GzipFile(fileobj=_Resumed(start, raw)).read(rest + 2) if start == b"\x1f\x8b" else start + raw.read(rest))


class _Resumed:
    """A stream whose first bytes were read already."""

    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def read(self, n: int = -1) -> bytes:
        if not self.start:
            return self.rest.read(min(n, 4096) if n > 0 else None)
        out, self.start = (self.start, b"") if n < 0 else (self.start[:n], self.start[n:])
        return out if n >= 0 else out + self.rest.read()


def _nrrd_header(raw) -> volumes.Header:
    head = b""
    while b"\n\n" not in head and (more := raw.read(1024)):
        head += more
    return volumes.nrrd_header(head.partition(b"\n\n")[0])


class Nifti(DataSource):
    suffix, header, decode = ".nii.gz", staticmethod(_nifti_header), staticmethod(volumes.decode_nifti)

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options), self.suffix, self.header, self.decode)


class Nrrd(Nifti):
    suffix, header, decode = ".nrrd", staticmethod(_nrrd_header), staticmethod(volumes.decode_nrrd)

    @classmethod
    def name(cls) -> str:
        return "nrrd"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Nifti, Nrrd):
        spark.dataSource.register(source)
