"""Binary edge files as a data source: little-endian pairs of 32 bits, any number of files, split by byte range.

A partition is a list of stretches (file, first pair, end pair), so a file of 80 GB is many tasks and many small files
are one. A cut-off pair at the end of a file belongs to no stretch. Bounds on src and dst that a query states are
applied to arrays as they are read, and only rows within them reach Spark. Written parts get their names when the whole
job is done, so a repeated or lost task leaves nothing behind.

Files are opened by pyarrow (local paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``), in the tasks; the driver lists names
and sizes only.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds

PAIR, NAME = 8, "edge_files"
#: Bytes of a partition, and pairs read at a time.
SPLIT, CHUNK = 64 << 20, 1 << 20
U32 = 0xFFFFFFFF
FIELDS = ("src", "dst")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, of a folder's files, or of the files that a pattern with ``*`` names, by name."""
    system, inner = opened(path)
    pattern = None
    if "*" in inner:
        pattern, inner = inner, posixpath.dirname(inner[: inner.index("*")] + "x")
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File]
    hidden = lambda name: any(part.startswith(("_", ".")) for part in name[len(inner) :].split("/"))
    return sorted((n, s) for n, s in names if (n == inner or not hidden(n)) and (pattern is None or fnmatch.fnmatch(n, pattern)))


@dataclass
class Stretches(ds.InputPartition):
    parts: list[tuple[str, int, int]]


def dealt(files: Iterable[tuple[str, int]], split: int) -> list[Stretches]:
    """Stretches of whole pairs, of about split bytes a partition."""
    most, out, room = max(1, split // PAIR), [], 0
    for name, size in files:
        at, end = 0, size // PAIR
        while at < end:
            if not room:
                out.append(Stretches([]))
                room = most
            to = min(end, at + room)
            out[-1].parts.append((name, at, to))
            room -= to - at
            at = to
    return out


class Bounds:
    """What a conjunction of comparisons leaves of each column."""

    def __init__(self) -> None:
        self.low, self.high = dict.fromkeys(FIELDS, 0), dict.fromkeys(FIELDS, U32)

    def takes(self, f: ds.Filter) -> bool:
        """Whether a filter is one of ours, and is then applied in full."""
        if isinstance(f, ds.IsNotNull):
            return True
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        value = getattr(f, "value", None)
        if column not in FIELDS or isinstance(value, bool) or not isinstance(value, int):
            return False
        steps = {ds.EqualTo: (value, value), ds.GreaterThan: (value + 1, None), ds.GreaterThanOrEqual: (value, None), ds.LessThan: (None, value - 1), ds.LessThanOrEqual: (None, value)}
        if type(f) not in steps:
            return False
        low, high = steps[type(f)]
        self.low[column] = self.low[column] if low is None else max(self.low[column], low)
        self.high[column] = self.high[column] if high is None else min(self.high[column], high)
        return True

    def within(self, pairs: np.ndarray) -> np.ndarray:
        keep = np.ones(len(pairs), bool)
        for k, column in enumerate(FIELDS):
            if self.low[column] > 0 or self.high[column] < U32:
                keep &= (pairs[:, k] >= self.low[column]) & (pairs[:, k] <= self.high[column])
        return pairs if keep.all() else pairs[keep]


class EdgeReader(ds.DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.bounds = path, split, Bounds()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return [f for f in filters if not self.bounds.takes(f)]

    def partitions(self) -> list[Stretches]:
        return dealt(listed(self.path), self.split)

    def read(self, partition: Stretches | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for name, at, end in partition.parts if partition else []:
            with system.open_input_file(name) as file:
                for first in range(at, end, CHUNK):
                    n = min(CHUNK, end - first)
                    pairs = self.bounds.within(np.frombuffer(file.read_at(n * PAIR, first * PAIR), "<u4").reshape(-1, 2).astype(np.int64))
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=list(FIELDS))


@dataclass
class Written(ds.WriterCommitMessage):
    temporary: str
    name: str


class EdgeWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.bin"
        temporary = f"{folder}/_job-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(posixpath.dirname(temporary), recursive=True)
        with system.open_output_stream(temporary) as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in FIELDS]
                if any(c.null_count for c in columns):
                    raise ValueError("an edge has a null end")
                pairs = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
                if len(pairs) and (pairs.min() < 0 or pairs.max() > U32):
                    raise ValueError("an id does not fit 32 bits")
                out.write(pairs.astype("<u4").tobytes())
        return Written(temporary, f"{folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for name, _ in listed(self.path):
                system.delete_file(name)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.name)
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, folder = opened(self.path)
        if system.get_file_info(f"{folder}/_job-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_job-{self.job}")


class EdgeFiles(ds.DataSource):
    """``spark.read.format("edge_files").load(path)``; option ``split`` sets the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> EdgeReader:
        return EdgeReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> EdgeWriter:
        return EdgeWriter(self.options["path"], overwrite)


def registered(spark) -> None:
    """Makes the format known to a session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdgeFiles)
