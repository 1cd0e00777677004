"""Other inputs: edge lists, topologies, alignments, ranges, matrices, arrays and catalogs."""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import window_of_name

#: Catalog files (fixed values of the format): magic, version, record layouts and the mark of no parent.
MAGIC, VERSION = b"SFC\0", 1
HEADER, RECORD = "<4sHII10x", "<IQQHBIIx"
NO_PARENT = 0xFFFFFFFF
MANIFEST_KEYS = ("graph_build_id", "graph_construction_pipeline", "reference_coordinates", "hprc_release", "haplotype_count", "snarl_decomposition_tool")


#: Schemes that edge_files opens itself; others are read through Hadoop.
OPENED = ("", "file", "s3", "gs")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """edges(src, dst) of binary files of little-endian pairs of 32 bits; a cut-off pair at the end is ignored.

    One relation whatever the number of files, in byte ranges, with bounds on src and dst applied while reading. Of
    stores that only Hadoop opens, files of whole pairs are one fixed-length input that is split; it refuses a cut-off
    pair, so files with one are read as values, up to the 2 GB that one may have.
    """
    if (path.partition(":")[0] if ":" in path else "") in OPENED:
        from .edge_files import NAME, registered

        registered(spark)
        return spark.read.format(NAME).load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                pairs = np.frombuffer(content[: len(content) // 8 * 8], "<u4").reshape(-1, 2).astype("int64")
                yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    def gathered(pairs: Iterator[bytes]) -> Iterator[tuple[bytes]]:
        while part := b"".join(itertools.islice(pairs, 1 << 16)):
            yield (part,)

    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    cut = [f["path"] for f in files if f["length"] % 8]
    whole = [f["path"] for f in files if f["length"] and f["length"] % 8 == 0]
    contents = spark.read.format("binaryFile").load(cut).select("content") if cut else spark.createDataFrame([], "content binary")
    if whole:
        contents = contents.union(spark.createDataFrame(spark.sparkContext.binaryRecords(",".join(whole), 8).mapPartitions(gathered), "content binary"))
    return contents.mapInPandas(decode, "src long, dst long")


def topology(spark: SparkSession, path: str) -> DataFrame:
    """snarls(snarl, kind, entry, exit, parent, region): ``.``, ``NA`` and empty are null, lines of under five fields are refused."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split("value", "\t", -1).alias("f"))

    def value(k: int):
        v = F.trim(F.get("f", F.lit(k)))
        return F.when(~v.isin(".", "NA", ""), v)

    checked = F.when(F.size("f") >= 5, value(0)).otherwise(F.raise_error(F.lit("a topology line has under five fields")).cast("string"))
    return rows.select(checked.alias("snarl"), F.lower(value(1)).alias("kind"), value(2).cast("bigint").alias("entry"), value(3).cast("bigint").alias("exit"), value(4).alias("parent"), value(5).alias("region"))


PAF = "qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, nmatch long, alnlen long, mapq int"


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """The twelve fixed columns of a PAF file, and its tags as an array."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t", -1).alias("f"))
    named = [c.split() for c in PAF.split(", ")]
    return parts.select(*[F.get("f", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(named)], F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0))).alias("tags"))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(start, end) of a CSV file without a header; malformed rows are dropped."""
    return spark.read.schema("start long, end long").csv(path, mode="DROPMALFORMED").where("start is not null and end is not null")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a CSV matrix without a header, one file a matrix."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    return text.select(F.col("row").cast("bigint").alias("row"), F.posexplode(F.split("line", ",")).alias("col", "v")).select("row", F.col("col").cast("bigint").alias("col"), F.col("v").try_cast("double").alias("value")).where("value is not null")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, i, value) of .npy vectors; start and end come from names like ``window_s_e``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                values = np.load(io.BytesIO(content), allow_pickle=False).astype(float).ravel()
                yield pd.DataFrame({"file": name, "i": np.arange(len(values)), "value": values})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, i long, value double")
    return found.withColumn("w", window_of_name(F.col("file"))).select("file", "w.start", "w.end", "i", "value")


class CatalogError(ValueError):
    """A catalog that is cut off, of another version, or inconsistent."""


#: RECORD as columns.
RECORD_COLUMNS = np.dtype([("feature_id", "<u4"), ("entry", "<u8"), ("exit", "<u8"), ("k", "<u2"), ("cyclic", "u1"), ("parent_feature", "<u4"), ("offset", "<u4"), ("pad", "u1")])
RECORD_SCHEMA = "feature_id long, entry long, exit long, k int, cyclic int, parent_feature long, offset long"


def catalog_rows(features: bytes) -> tuple[np.ndarray, int]:
    """The records of a catalog file as RECORD_COLUMNS, and the number of traversals its header names."""
    head = struct.calcsize(HEADER)
    if len(features) < head:
        raise CatalogError("the header is cut off")
    magic, version, n, n_lists = struct.unpack_from(HEADER, features)
    if magic != MAGIC or version != VERSION:
        raise CatalogError("not a catalog of this version")
    if len(features) != head + n * RECORD_COLUMNS.itemsize:
        raise CatalogError("the number of records does not fit the file")
    return np.frombuffer(features, RECORD_COLUMNS, n, head), n_lists


def catalog_lists(traversals: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Where each node list of a traversal file begins, and its nodes."""
    at = 0
    while at < len(traversals):
        if at + 2 > len(traversals):
            raise CatalogError("a traversal is cut off")
        (count,) = struct.unpack_from("<H", traversals, at)
        if at + 2 + 8 * count > len(traversals):
            raise CatalogError("a traversal is cut off")
        yield at, np.frombuffer(traversals, "<u8", count, at + 2)
        at += 2 + 8 * count


def read_catalog(features: bytes, traversals: bytes) -> tuple[pd.DataFrame, list[list[int]]]:
    """Records and allele node lists of a small catalog; refuses wrong magic, version, sizes and counts."""
    rows, n_lists = catalog_rows(features)
    table = pd.DataFrame(rows).drop(columns="pad")
    table["parent_feature"] = [None if p == NO_PARENT else p for p in rows["parent_feature"].tolist()]
    lists = [nodes.tolist() for _, nodes in catalog_lists(traversals)]
    if len(lists) != n_lists:
        raise CatalogError("the number of traversals does not fit the header")
    return table, lists


def catalog(spark: SparkSession, features: str, traversals: str) -> tuple[DataFrame, DataFrame]:
    """records(feature_id, entry, exit, k, cyclic, parent_feature, offset) and lists(i, at, nodes) of a catalog's two
    files, as read_catalog. ``at`` is the place that a record's offset names; a record's lists follow from there.

    A file is one value of an executor, of 2 GB at most (67 million records). Nothing but counts comes to the driver.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows, _ = catalog_rows(content)
                for at in range(0, len(rows), 1 << 18):
                    part = pd.DataFrame({name: rows[name][at : at + (1 << 18)].astype("int64") for name in RECORD_COLUMNS.names[:-1]})
                    part["parent_feature"] = part["parent_feature"].astype("Int64").mask(part["parent_feature"] == NO_PARENT)
                    yield part

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                found = enumerate(catalog_lists(content))
                while part := [(i, at, nodes.astype("int64")) for i, (at, nodes) in itertools.islice(found, 1 << 14)]:
                    yield pd.DataFrame(part, columns=["i", "at", "nodes"])

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [catalog_rows(content)[1] for content in pdf["content"]]})

    files = spark.read.format("binaryFile")
    found = files.load(traversals).select("content").mapInPandas(lists, "i long, at long, nodes array<long>")
    if files.load(features).select("content").mapInPandas(named, "n long").agg(F.sum("n")).first()[0] != found.count():
        raise CatalogError("the number of traversals does not fit the header")
    return files.load(features).select("content").mapInPandas(records, RECORD_SCHEMA), found


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys and values of a manifest, one tab-separated pair a line; all required keys must be there."""
    found = {r["k"]: r["v"] for r in spark.read.text(path).select(F.split("value", "\t").alias("f")).select(F.get("f", F.lit(0)).alias("k"), F.get("f", F.lit(1)).alias("v")).collect()}
    missing = [k for k in MANIFEST_KEYS if k not in found]
    if missing:
        raise CatalogError(f"the manifest lacks {', '.join(missing)}")
    return found
