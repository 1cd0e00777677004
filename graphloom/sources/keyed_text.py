"""Segments of graph text by name: a table of where each record lies, and reads of those bytes alone.

The index is made by one scan in byte ranges, each task taking the lines that start in its stretch; only names and
places leave it, laid out by name. A lookup takes the places of its names from the files of the index whose range of
names they fall into, deals them by file and stretch, and reads each record's bytes. Compressed text has no places and is
refused; gfa.sequences_of scans it. Files are opened as in edge_files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .edge_files import SPLIT, Stretches, listed, opened

NAME = "segment_places"
#: Bytes read at a time, bytes of a line that hold its name at the most, and names that are looked up by value.
CHUNK, HEAD, FEW = 8 << 20, 1 << 14, 10_000
SCHEMA = "name string, file string, offset bigint, bytes bigint"


def lines_from(file, size: int, begin: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes, head) of the lines that start in [begin, end), without their ends."""
    at, head = begin, b""
    start = begin if not begin or file.read_at(1, begin - 1) == b"\n" else None
    while at < size:
        data = file.read_at(min(CHUNK, size - at), at)
        here = 0
        for stop in np.flatnonzero(np.frombuffer(data, np.uint8) == 10).tolist():
            if start is not None:
                yield start, at + stop - start, (head + data[here : min(stop, here + HEAD)])[:HEAD]
            here, head = stop + 1, b""
            start = at + here
            if start >= end:
                return
        if start is not None:
            head = (head + data[here : here + HEAD])[:HEAD]
        at += len(data)
    if start is not None and start < size:
        yield start, size - start, head


class PlaceReader(ds.DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Stretches]:
        files = listed(self.path)
        if any(name.endswith((".gz", ".bz2", ".zst")) for name, _ in files):
            raise ValueError("compressed text has no places")
        return [Stretches([(name, a, min(size, a + self.split))]) for name, size in files for a in range(0, size, self.split)]

    def read(self, partition: Stretches | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for name, begin, end in partition.parts if partition else []:
            with system.open_input_file(name) as file:
                rows: list[tuple[str, str, int, int]] = []
                for offset, length, head in lines_from(file, file.size(), begin, end):
                    fields = head.split(b"\t", 2)
                    if fields[0] == b"S" and len(fields) > 1:
                        rows.append((fields[1].decode().strip(), name, offset, length))
                    if len(rows) == 100_000:
                        yield self._batch(rows)
                        rows = []
                if rows:
                    yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
        names, files, offsets, lengths = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["name", "file", "offset", "bytes"])


class SegmentPlaces(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlaceReader:
        return PlaceReader(self.options["path"], int(self.options.get("split", SPLIT)))


def write_index(spark: SparkSession, path: str, index: str, split: int = SPLIT) -> None:
    """(name, file, offset, bytes) of every segment of the text below path, laid out by name."""
    spark.dataSource.register(SegmentPlaces)
    found = spark.read.format(NAME).option("split", split).load(path)
    found.where("name <> ''").repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(index)


def places(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """The rows of an index for wanted(name). Up to FEW names are compared by value, which skips files and row groups."""
    names = wanted.select("name").where("name is not null").distinct()
    few = [r[0] for r in names.limit(FEW + 1).collect()]
    table = spark.read.parquet(index)
    return table.where(F.col("name").isin(few)) if len(few) <= FEW else table.join(names, "name", "left_semi")


def sequences_of(spark: SparkSession, path: str, index: str, wanted: DataFrame, stretch: int = SPLIT) -> DataFrame:
    """(name, seq) of the segments asked for by wanted(name), from their own bytes; ``*`` and a missing field have none.

    A name that several records have gives several rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(path)
        last, file = None, None
        for batch in batches:
            names, seqs = [], []
            for r in batch.to_pylist():
                if r["file"] != last:
                    last, file = r["file"], system.open_input_file(r["file"])
                fields = file.read_at(r["bytes"], r["offset"]).rstrip(b"\r\n").split(b"\t")
                seq = fields[2].strip() if len(fields) > 2 else b"*"
                if seq and seq != b"*":
                    names.append(r["name"])
                    seqs.append(seq.decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string())], names=["name", "seq"])

    found = places(spark, index, wanted).withColumn("stretch", F.floor(F.col("offset") / stretch))
    near = found.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("name", "file", "offset", "bytes")
    return near.mapInArrow(read, "name string, seq string")
