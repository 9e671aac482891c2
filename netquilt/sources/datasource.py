"""``spark.read.format("netquilt-pcap").load(folder)``: captures as a Python data source.

Option ``part`` sets the bytes that a task reads, about. Comparisons of a column
with a constant are tested on each record as it is read, so what fails never
leaves the reader.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import captures

NAME = "netquilt-pcap"
_COMPARED: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda v, among: v in among}
#: Columns of ``PACKETS`` that filters are tested on, with their place in a row of ``read_packets``.
_TESTED = {name: i - 1 for i, name in enumerate(captures.COLUMNS) if name not in ("path", "ts")}


class Part(InputPartition):
    def __init__(self, path: str, offset: int, n: int, seq: int):
        self.path, self.offset, self.n, self.seq = path, offset, n, seq


class CaptureReader(DataSourceReader):
    """Reads a file or the captures of a folder, part by part."""

    def __init__(self, options: dict):
        self.where = options["path"]
        self.size = int(options.get("part", captures.PART))
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name in _TESTED and (type(f) in _COMPARED or isinstance(f, IsNotNull)):
                self.tests.append((_TESTED[name], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, path = captures.opened(self.where)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".pcap")]
        prefix = self.where[: len(self.where) - len(path)] if self.where.endswith(path) else ""
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.size <= self.size:
                out.append(Part(prefix + f.path, 0, f.size, 0))
                continue
            with store.open_input_stream(f.path, buffer_size=captures.BUFFER) as stream:
                out += [Part(prefix + f.path, *p) for p in captures.parts(stream, self.size)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        from datetime import datetime, timedelta, timezone

        epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
        rows = captures.part_of(partition.path, max(partition.offset, captures.HEAD), partition.n, partition.seq)
        for row in rows:
            if all(row[i] is not None and (kind is IsNotNull or _COMPARED[kind](row[i], value)) for i, kind, value in self.tests):
                yield partition.path, row[0], epoch + timedelta(microseconds=row[1]), *row[2:]


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return captures.PACKETS

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
