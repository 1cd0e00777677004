"""Merging and reporting of intervals and runs of ids, by running maxima within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def merged(intervals: DataFrame, by: Sequence[str], size: int = blocks.PLACES) -> DataFrame:
    """(by, start, end) with overlapping and touching intervals merged; none ends before its start.

    Keys are cut into blocks of ``size`` places, so that one key may hold most intervals.
    """
    order = ["start", "end"]
    reached = blocks.running(intervals.select(*by, *order), by, order, F.col("end"), "before", F.max, True, size, True)
    new = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    island = blocks.running(reached.withColumn("new", new), by, order, F.col("new"), "island", size=size, nulls=True)
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def report(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ranges): merged intervals as text, a single point once."""
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    rows = merged(intervals, by).select(*by, F.struct("start", text.alias("text")).alias("r"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), ", ").alias("ranges"))


def id_runs(ids: DataFrame, by: Sequence[str], name: str, size: int = blocks.PLACES) -> DataFrame:
    """(by, start, end) of runs of consecutive ids."""
    counted = blocks.running(ids.select(*by, name).distinct(), by, [name], F.lit(1), "run", size=size, nulls=True)
    runs = counted.withColumn("run", F.col(name) - F.col("run"))
    return runs.groupBy(*by, "run").agg(F.min(name).alias("start"), F.max(name).alias("end")).drop("run")


def id_ranges(ids: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(by, ranges): ``1-3, 5-6, 8``."""
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    rows = id_runs(ids, by, name).select(*by, F.struct("start", text.alias("text")).alias("r"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), ", ").alias("ranges"))


def coverage(intervals: DataFrame, by: Sequence[str], length: int) -> DataFrame:
    """(by, percent) of a length under inclusive intervals, counted once where they overlap."""
    return merged(intervals, by).groupBy(*by).agg((F.sum(F.col("end") - F.col("start") + 1) / length * 100).alias("percent"))


def first_hits(intervals: DataFrame, by: Sequence[str], start: int, end: int, slack: int = 500, most: int = 2) -> DataFrame:
    """The first ``most`` intervals of each key that meet a region widened by slack."""
    near = intervals.where((F.col("start") <= end + slack) & (F.col("end") >= start - slack))
    order = Window.partitionBy(*by).orderBy("start", "end")
    return near.withColumn("hit", F.row_number().over(order)).where(F.col("hit") <= most)


def longest(intervals: DataFrame, by: Sequence[str], *ties: str) -> DataFrame:
    """The longest interval of each key; the earliest of several."""
    best = F.max_by(F.struct("start", "end", *ties), F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), *[(-F.col(t)).alias(t) for t in ties]))
    return intervals.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
