"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's 3-word shingles. Two fingerprints
that differ in at most two bits both lie within one bit of a common value, so every distinct fingerprint emits the
65 values within half the radius, the values are shuffled, and fingerprints that meet under one value are linked.

All fingerprints under a value v are v itself or v with one bit flipped. A group's members are therefore held as
one 64-bit mask of flipped bits and one flag, both combined map-side by bit_or: no list is gathered and no group
grows beyond 65. Members of a group are joined to its least member (each such pair is within two bits and is
verified), which keeps every component although not every pair is written out. What a fingerprint belongs to goes back
to its rows by a join that is split: fingerprints of many rows (blank texts, boiler-plate) by broadcast, the others by
a shuffle.

Cases: a very long text is hashed whole, in blocks; a null, empty or blank text has no shingle and the fingerprint zero, which links like any other; a text of
one or two words has one shingle; a null id takes part but is never a component's id unless all its members' ids
are null, and ids, null or repeated, never join clusters in ``keep_one``; repeated rows share a fingerprint; an
empty table gives no rows; other columns are ignored, or carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, cut, numbered, table, without

SEED = 42
#: Fingerprints of more than this share of all rows are told to every task, 1 / HEAVY of 24 bytes at most.
HEAVY = 0.001
#: Shingles hashed at a time: bounds the bit matrix of one text at 4 MB.
BLOCK = 1 << 16


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit majority of the text's shingle hashes, unsigned; 0 if there are none."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and \x20 \x09-\x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    stops = (ends - 1)[min(n, len(words)) - 1 :].tolist()
    starts = [0, *ends.tolist()][: len(stops)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column fp) that keep every component of radius 2."""
    bit = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")
    flipped = F.expr("CASE WHEN bit < 0 THEN 0L ELSE shiftleft(1L, bit) END")
    ball = prints.select("fp", bit).select(F.col("fp").bitwiseXOR(flipped).alias("v"), flipped.alias("mask"), F.expr("CASE WHEN bit < 0 THEN 1 ELSE 0 END").alias("own"))
    met = ball.groupBy("v").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where("bit_count(mask) + own > 1")
    bits = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1L) = 1L), i -> v ^ shiftleft(1L, i))")
    members = met.select(F.when(F.col("own") == 1, F.array_append(bits, F.col("v"))).otherwise(bits).alias("m"))
    pairs = members.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a < b and bit_count(a ^ b) <= 2")
    return pairs.distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, fp, component (the smallest id reachable), root (the smallest fingerprint reachable).

    Clusters are told apart by root alone: several may have the same component where ids are null or repeated.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = cut(docs.select(row.alias("row"), F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    joined = prints.join(roots, "fp").select("fp", "root", "first")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    linked = joined.join(least, "root").select("fp", "component", "root")
    of = cut(prints.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"), F.coalesce("root", "fp").alias("root")))
    frequent = rows.stat.freqItems(["fp"], HEAVY).select(F.explode("fp_freqItems").alias("fp"))
    heavy = cut(of.join(F.broadcast(frequent), "fp", "left_semi"))
    marked = rows.join(F.broadcast(heavy), "fp", "left")
    light = marked.where("root is null").select("row", "id", "fp").join(of, "fp")
    columns = ("row", "id", "fp", "component", "root")
    return marked.where("root is not null").select(*columns).unionByName(light.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), of repeats of the id the first."""
    rows, row = numbered(docs)
    found = cut(near_components(rows, id_col, text_col, row).select("row", "id", "root"))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    return without(rows, row, found.select("row").join(stays.select(F.col("first.row").alias("row")), "row", "left_anti"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
