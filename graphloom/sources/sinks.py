"""Outputs. Tables are Parquet; text and binary forms are for exchange with other tools."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import running_total
from .tables import HEADER, MAGIC, MANIFEST_KEYS, NO_PARENT, RECORD, RECORD_COLUMNS, VERSION, CatalogError


def edges(df: DataFrame, path: str, width: int = 1_000_000) -> None:
    """Edges laid out by ranges of src, so that a node range or window reads few files and row groups."""
    df.withColumn("src_range", F.floor(F.col("src") / width)).repartition("src_range").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("src_range").parquet(path)


def edge_files(df: DataFrame, path: str) -> None:
    """The edges as binary files, one a partition, written where they are and named when all are done."""
    from .edge_files import NAME, registered

    registered(df.sparkSession)
    df.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).write.format(NAME).mode("append").save(path)


def edge_bytes(df: DataFrame) -> Iterable[bytes]:
    """The edges in order as little-endian pairs of 32 bits, in pieces packed by the executors, one partition of them
    on the driver at a time. Ids of over 32 bits are refused."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = pdf.to_numpy()
            if len(pairs) and (pairs.min() < 0 or pairs.max() > 0xFFFFFFFF):
                raise ValueError("an id does not fit 32 bits")
            yield pd.DataFrame({"content": [pairs.astype("<u4").tobytes()]})

    parts = df.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInPandas(pack, "content binary")
    for row in parts.toLocalIterator(prefetchPartitions=True):
        yield bytes(row["content"])


def matrix_csv(coo: DataFrame, n: int, path: str) -> None:
    """A dense matrix as lines of comma-separated values with one decimal at least, no header."""
    cells = coo.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value").cast("double").alias("value")))).alias("m"))
    all_rows = coo.sparkSession.range(n).select(F.col("id").alias("row")).join(cells, "row", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.try_element_at("m", c.cast("bigint")), F.lit(0.0)).cast("string")), ",")
    all_rows.select("row", line.alias("value")).repartitionByRange("row").sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)


def vector_csv(values: DataFrame, order: str, value: str, path: str) -> None:
    """A vector on one line."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), ",")
    values.agg(line.alias("value")).write.mode("overwrite").text(path)


def csr(coo: DataFrame, path: str, by: str = "win") -> None:
    """Sparse matrices as one row for each entry, by window: (win, row, col, value)."""
    coo.sortWithinPartitions(by, "row", "col").write.mode("overwrite").partitionBy(by).parquet(path)


def csr_arrays(rows: list[tuple[int, int, float]]) -> dict[str, np.ndarray]:
    """values, col_indices, row_ptr and shape of one small block given as (row, col, value)."""
    nodes = sorted({r for r, _, _ in rows} | {c for _, c, _ in rows})
    place = {n: k for k, n in enumerate(nodes)}
    entries = sorted((place[r], place[c], v) for r, c, v in rows)
    counts = np.bincount([r for r, _, _ in entries], minlength=len(nodes)) if entries else np.zeros(len(nodes), int)
    return {"values": np.array([v for *_, v in entries], float), "col_indices": np.array([c for _, c, _ in entries], np.uint64), "row_ptr": np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64), "shape": np.array([len(nodes)] * 2, np.uint64)}


def scores_csv(scores: DataFrame, path: str) -> None:
    """start_node, end_node and score with a header."""
    scores.select("start_node", "end_node", "ngec").write.mode("overwrite").csv(path, header=True)


def features_tsv(encoded: DataFrame, path: str) -> None:
    """feature_index and value, NA for null."""
    encoded.select(F.col("feature").alias("feature_index"), "value").sort("feature_index").write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def fasta(records: DataFrame, path: str) -> None:
    """records(file, record), one folder a file name."""
    records.select("file", F.col("record").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def catalog_bytes(records: list[dict], alleles: list[list[list[int]]]) -> tuple[bytes, bytes]:
    """The two binary files of a catalog: records in order, and each one's allele node lists."""
    traversals, offsets, n = bytearray(), [], 0
    for lists in alleles:
        offsets.append(len(traversals))
        for nodes in lists:
            if len(nodes) > 0xFFFF:
                raise CatalogError("an allele has more nodes than 16 bits can count")
            traversals += struct.pack(f"<H{len(nodes)}Q", len(nodes), *nodes)
            n += 1
    if len(traversals) > 0xFFFFFFFF:
        raise CatalogError("the traversals exceed 32-bit offsets")
    head = struct.pack(HEADER, MAGIC, VERSION, len(records), n)
    body = b"".join(struct.pack(RECORD, r["feature_id"], r["entry"], r["exit"], r["k"], int(r["cyclic"]), NO_PARENT if r["parent_feature"] is None else r["parent_feature"], at) for r, at in zip(records, offsets))
    return head + body, bytes(traversals)


def catalog_pieces(records: DataFrame, alleles: DataFrame) -> tuple[Iterator[bytes], Iterator[bytes]]:
    """The two binary files of a catalog in pieces that the executors pack: records(feature_id, entry, exit, k, cyclic,
    parent_feature) by id, and alleles(feature_id, idx, nodes) by id and idx. A partition at a time is on the driver.

    Offsets are running totals over ranges of ids. Ids occur once; an allele of an unknown id is left out.
    """
    own = alleles.join(records.select("feature_id"), "feature_id", "left_semi")
    sized = own.groupBy("feature_id").agg(F.sum(2 + 8 * F.size("nodes").cast("bigint")).alias("bytes"), F.count("*").alias("lists"), F.max(F.size("nodes")).alias("most"))
    facts = sized.agg(F.sum("bytes"), F.sum("lists"), F.max("most")).first()
    if (facts[2] or 0) > 0xFFFF:
        raise CatalogError("an allele has more nodes than 16 bits can count")
    if (facts[0] or 0) > 0xFFFFFFFF:
        raise CatalogError("the traversals exceed 32-bit offsets")
    full = records.join(sized, "feature_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    placed = full.drop("lists", "most").join(running_total(full, "feature_id", "bytes", "after"), "feature_id")
    numbers = ["feature_id", "entry", "exit", "k", F.col("cyclic").cast("int").alias("cyclic"), F.coalesce("parent_feature", F.lit(NO_PARENT)).alias("parent_feature"), (F.col("after") - F.col("bytes")).alias("offset")]

    def pack_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.zeros(len(pdf), RECORD_COLUMNS)
            for name in pdf.columns:
                rows[name] = pdf[name]
            yield pd.DataFrame({"content": [rows.tobytes()]})

    def pack_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"content": [b"".join(struct.pack("<H", len(nodes)) + np.asarray(nodes, "<u8").tobytes() for nodes in pdf["nodes"])]})

    def pieces(rows: DataFrame, pack) -> Iterator[bytes]:
        for row in rows.mapInPandas(pack, "content binary").toLocalIterator(prefetchPartitions=True):
            yield bytes(row["content"])

    head = struct.pack(HEADER, MAGIC, VERSION, records.count(), facts[1] or 0)
    ordered = placed.select(*numbers).repartitionByRange("feature_id").sortWithinPartitions("feature_id")
    lists = own.repartitionByRange("feature_id", "idx").sortWithinPartitions("feature_id", "idx").select("nodes")
    return itertools.chain([head], pieces(ordered, pack_records)), pieces(lists, pack_lists)


def manifest(df_session, values: dict[str, str], path: str) -> None:
    """One tab-separated pair a line; refuses tabs and line ends in values, and missing keys."""
    for k in MANIFEST_KEYS:
        if k not in values:
            raise CatalogError(f"the manifest lacks {k}")
    if any(c in str(v) for v in values.values() for c in "\t\r\n"):
        raise CatalogError("a manifest value holds a tab or a line end")
    df_session.createDataFrame([(f"{k}\t{v}",) for k, v in values.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def image_bytes(pixels: DataFrame, width: int, height: int) -> Iterable[bytes]:
    """pixels(x, y, r, g, b) as an uncompressed 24-bit TGA image, rows from y = 0 on, in pieces packed by the executors."""
    if not (0 < width <= 0xFFFF and 0 < height <= 0xFFFF):
        raise ValueError("sides of an image have 16 bits")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line in pdf["line"]:
                row = np.zeros((width, 3), np.uint8)
                for p in line if line is not None else []:
                    row[p["x"]] = p["b"], p["g"], p["r"]
                rows.append(row.tobytes())
            yield pd.DataFrame({"content": [b"".join(rows)]})

    lines = pixels.groupBy("y").agg(F.collect_list(F.struct("x", "r", "g", "b")).alias("line"))  # a row's width at most
    every = pixels.sparkSession.range(height).select(F.col("id").alias("y")).join(lines, "y", "left")
    yield struct.pack("<BBB5x2H2HBB", 0, 0, 2, 0, 0, width, height, 24, 0)
    for part in every.repartitionByRange("y").sortWithinPartitions("y").select("line").mapInPandas(pack, "content binary").toLocalIterator(prefetchPartitions=True):
        yield bytes(part["content"])
