"""Files of a folder as a stream: readStream.format("settledfiles").load(folder), each once, when it has stopped growing.

A file is taken when two listings, a trigger apart, show the same size and time of change. Each step of the stream writes the
names of its files to `log` (a folder that outlives the query) before it is given out, so that a stream that is started again, or a
batch that is repeated, has the same files. Rows are (path, size, content); a content column is read only where the schema has one.

Options: path, log, suffix, maxFiles (of a step, 1000).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Chosen(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class SettledReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        from ..sources.formats import store_of

        low = {k.lower(): v for k, v in options.items()}
        if not low.get("path") or not low.get("log"):
            raise ValueError("the options path and log are needed")
        self.names, self.suffix, self.most = schema.names, low.get("suffix", ""), int(low.get("maxfiles", 1000))
        self.folder, (self.logs, self.log) = low["path"], store_of(low["log"])
        self.logs.create_dir(self.log, recursive=True)
        self.before: dict[str, tuple] = {}
        self.step, self.taken = 0, set()
        while (step := self._logged(self.step + 1)) is not None:
            self.step += 1
            self.taken.update(path for path, _ in step)

    def _name(self, step: int) -> str:
        return f"{self.log}/{step:012d}.json"

    def _logged(self, step: int) -> list[list] | None:
        from pyarrow import fs

        if self.logs.get_file_info(self._name(step)).type == fs.FileType.NotFound:
            return None
        with self.logs.open_input_stream(self._name(step)) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        from ..sources.formats import infos

        now = {path: (size, time) for path, size, time in infos(self.folder, self.suffix) if path not in self.taken}
        ready = sorted((seen[1], path, seen[0]) for path, seen in now.items() if self.before.get(path) == seen)[: self.most]
        self.before = now
        if ready:
            step = [[path, size] for _, path, size in ready]
            hidden = f"{self._name(self.step + 1)}.part"
            with self.logs.open_output_stream(hidden) as f:
                f.write(json.dumps(step).encode())
            self.logs.move(hidden, self._name(self.step + 1))
            self.step += 1
            self.taken.update(path for path, _ in step)
        return {"step": self.step}

    def partitions(self, start: dict, end: dict) -> list[Chosen]:
        files = [tuple(x) for k in range(start["step"], end["step"]) for x in self._logged(k + 1)]
        return [Chosen(files[i : i + 16]) for i in range(0, len(files), 16)]

    def read(self, partition: Chosen) -> Iterator[tuple]:
        from ..sources.formats import store_of

        for path, size in partition.files:
            row = {"path": path, "size": size}
            if "content" in self.names:
                store, base = store_of(path)
                with store.open_input_stream(base, compression=None) as f:
                    row["content"] = f.read()
            yield tuple(row[c] for c in self.names)


class SettledFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "settledfiles"

    def schema(self) -> str:
        return "path string, size long, content binary"

    def streamReader(self, schema: StructType) -> SettledReader:
        return SettledReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SettledFiles)
