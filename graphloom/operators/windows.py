"""Index windows over nodes or coordinates, and what falls into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import laplacian


def node_windows(spark: SparkSession, start: int, end: int, size: int, overlap: int) -> DataFrame:
    """Half-open (start, end) of full windows every size - overlap, and the last ``size`` nodes if some are left.

    A last window that repeats one of the full ones is given once.
    """
    if size <= 0 or overlap < 0 or overlap >= size or end - start < size:
        raise ValueError("a window must be larger than its overlap and fit the range")
    step = size - overlap
    full = spark.range(start, end - size + 1, step).select(F.col("id").alias("start"), (F.col("id") + size).alias("end"))
    following = start + ((end - size - start) // step + 1) * step
    if following < end:
        full = full.unionByName(spark.range(1).select(F.lit(end - size).cast("bigint").alias("start"), F.lit(end).cast("bigint").alias("end")))
    return full.distinct()


def coordinate_windows(spark: SparkSession, start: int, end: int, size: int) -> DataFrame:
    """Consecutive windows of a region; the last may be shorter."""
    return spark.range(start, end, size).select(F.col("id").alias("start"), F.least(F.col("id") + size, F.lit(end)).alias("end"))


def sliding_ranges(spark: SparkSession, last: int, width: int = 200, step: int = 5) -> DataFrame:
    """Inclusive node ranges of a width, from every step-th node up to the last node."""
    return spark.range(0, last + 1, step).select(F.col("id").alias("start"), (F.col("id") + width).alias("end"))


def edges_in_windows(edges: DataFrame, start: int, end: int, size: int, overlap: int) -> DataFrame:
    """(win, src, dst) for every window that holds both ends.

    The windows that hold a node follow from its id, so an edge is exploded into the few windows that hold its lesser
    end and kept where they hold the greater: no join at all, and no window ever meets every edge.
    """
    step = size - overlap
    count = (end - size - start) // step + 1
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    first = F.greatest(F.ceil((high - size + 1 - start) / step), F.lit(0))
    last = F.least(F.floor((low - start) / step), F.lit(count - 1))
    # windows that hold both ends begin after high - size and not after low
    starts = F.when(first <= last, F.transform(F.sequence(first, F.greatest(last, first)), lambda k: k * step + start)).otherwise(F.array().cast("array<bigint>"))
    tail = end - size
    if start + count * step < end:
        holds = (low >= tail) & (high < end)
        starts = F.when(holds, F.array_union(starts, F.array(F.lit(tail).cast("bigint")))).otherwise(starts)
    near = edges.where((low >= start) & (high < end))
    return near.select(F.explode(starts).alias("win"), "src", "dst")


def window_laplacians(edges: DataFrame, start: int, end: int, size: int, overlap: int) -> DataFrame:
    """(win, row, col, value): undirected edges once, loops cancelled."""
    return laplacian(edges_in_windows(edges, start, end, size, overlap), loops="cancel", multi="drop", by=("win",))


def labelled(intervals: DataFrame, names: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """intervals(start, end, ...) with each of the overlapping names(name, lo, hi): an equi-join on buckets of places."""

    def buckets(a: str, b: str):
        return F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket)))

    met = intervals.withColumn("__bucket", buckets("start", "end")).join(names.withColumn("__bucket", buckets("lo", "hi")), "__bucket")
    met = met.where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))
    # a pair is kept in the first bucket both are in
    return met.where(F.col("__bucket") == F.floor(F.greatest("start", "lo") / bucket)).drop("__bucket")
