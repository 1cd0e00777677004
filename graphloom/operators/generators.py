"""Synthetic graphs as edge frames. Random edges hash the pair and a seed, so the same call gives the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _chance(seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def circulant(spark: SparkSession, n: int, steps: tuple[int, ...]) -> DataFrame:
    """Each node to those so many steps on, around a ring."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") + k) % n for k in steps])).alias("dst"))


def path_of_cliques(spark: SparkSession, communities: int, size: int) -> DataFrame:
    """Complete communities in a row, each joined to the next by one edge."""
    n = communities * size
    inside = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id"), F.floor(F.col("id") / size) * size + size - 1)).alias("dst")).where("src <> dst")
    return inside.unionByName(spark.range(communities - 1).select((F.col("id") * size + size - 1).alias("src"), (F.col("id") * size + size).alias("dst")))


def communities(spark: SparkSession, n: int, size: int, inside: float, outside: float, seed: int = 1) -> DataFrame:
    """Pairs of one community with one chance, of two communities with another."""
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("bigint"))).alias("dst")).where(F.col("dst") < n)
    chance = F.when(F.floor(F.col("src") / size) == F.floor(F.col("dst") / size), inside).otherwise(outside)
    return pairs.where(_chance(seed, F.col("src"), F.col("dst")) < chance)


def near_bipartite(spark: SparkSession, left: int, right: int, across: float, within: float, seed: int = 1) -> DataFrame:
    """Two sides with many edges across and a few within."""
    n = left + right
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("bigint"))).alias("dst")).where(F.col("dst") < n)
    crossing = (F.col("src") < left) & (F.col("dst") >= left)
    return pairs.where(_chance(seed, F.col("src"), F.col("dst")) < F.when(crossing, across).otherwise(within))


def side_by_side(*graphs: tuple[DataFrame, int]) -> DataFrame:
    """Graphs of (edges, nodes) with their ids moved apart."""
    out, start = None, 0
    for edges, n in graphs:
        moved = edges.select((F.col("src") + start).alias("src"), (F.col("dst") + start).alias("dst"))
        out, start = (moved if out is None else out.unionByName(moved)), start + n
    return out


def perturbed(edges: DataFrame, n: int, drop: float, add: int, seed: int = 1) -> DataFrame:
    """edges less a share of them, with so many random pairs of n nodes added."""
    kept = edges.where(_chance(seed, F.col("src"), F.col("dst")) >= drop)
    extra = edges.sparkSession.range(add).select(F.floor(_chance(seed + 1, F.col("id")) * n).alias("src"), F.floor(_chance(seed + 2, F.col("id")) * n).alias("dst")).where("src <> dst")
    return kept.select("src", "dst").unionByName(extra)


def digit_ring(ids: DataFrame, digits: int) -> DataFrame:
    """Edges over ids(id) that run from 0 without a gap: a clique among ids that differ in one of their last decimal
    digits, and a ring over what stands before these. Its Laplacian has the eigenvalues 10 a + 2 - 2 cos(2 pi j / m), a
    up to digits, m the numbers before the digits, j below m."""
    n = ids.count()
    tens = 10**digits
    if n % tens:
        raise ValueError(f"{n} ids do not end in {digits} full digits")
    ahead = F.array(*(F.when(F.expr(f"id div {10**p} % 10 < {10 - k}"), F.col("id") + k * 10**p) for p in range(digits) for k in range(1, 10)), *([(F.col("id") + tens) % n] if n > tens else []))
    return ids.select(F.col("id").alias("src"), F.explode(ahead).alias("dst")).where("dst is not null")
