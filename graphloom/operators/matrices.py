"""Statistics over long matrices (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import intensity


def long_form(df: DataFrame, key: str, array: str) -> DataFrame:
    """(row, col, value) of an array column."""
    return df.select(F.col(key).alias("row"), F.posexplode(array).alias("col", "value")).withColumn("value", F.col("value").cast("double"))


def standardized(cells: DataFrame, by: str = "col") -> DataFrame:
    """Adds z, (x - (m - 2s)) / 4s clamped to [0, 1], with mean and population deviation over the non-zero cells."""
    facts = cells.where("value <> 0").groupBy(by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - (F.col("m") - 2 * F.col("s"))) / (4 * F.col("s"))
    return cells.join(facts, by).select("row", "col", "value", F.when(F.col("s") > 0, F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))).otherwise(0.5).alias("z"))


def min_max(cells: DataFrame) -> DataFrame:
    """Adds intensity over the whole matrix; zeros are 0."""
    facts = cells.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return cells.join(F.broadcast(facts), F.lit(True)).select("row", "col", "value", F.when(F.col("value") == 0, 0.0).otherwise(intensity(F.col("value"), F.col("low"), F.col("high"))).alias("intensity"))


def weighted_importance(vectors: DataFrame, values: DataFrame) -> DataFrame:
    """(row, importance): sum of |v| times the min-max scaled eigenvalue, over vectors(row, k, v) and values(k, eigenvalue)."""
    facts = values.agg(F.min("eigenvalue").alias("low"), F.max("eigenvalue").alias("high"))
    scaled = values.join(F.broadcast(facts), F.lit(True)).select("k", intensity(F.col("eigenvalue"), F.col("low"), F.col("high")).alias("w"))
    return vectors.join(scaled, "k").groupBy("row").agg(F.sum(F.abs("v") * F.col("w")).alias("importance"))
