"""A stored index of places along walks: steps laid out by walk and step, sampled offsets, and what each file holds.

Offsets are computed once, when the index is written. A lookup asks two small tables, the samples (one in so many steps)
and the extents (one row for each file and walk), which files hold what it needs, and opens only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, coords

#: Steps of a file, the distance of samples in steps, and the most files of one lookup.
FILE_STEPS, EVERY, MOST_FILES = 5_000_000, 10, 50_000


def write(walks: DataFrame, path: str, every: int = EVERY, file_steps: int = FILE_STEPS, base: str | None = None) -> None:
    """Steps with start and end of walks(walk, step, node, fwd, len) below path, with their samples and extents."""
    spark = walks.sparkSession
    placed = coords.offsets(walks, base=base).select("walk", "step", "node", "fwd", "len", "start", "end")
    files = max(1, -(-walks.count() // file_steps))
    placed.repartitionByRange(files, "walk", "step").sortWithinPartitions("walk", "step").write.mode("overwrite").parquet(f"{path}/steps")
    steps = spark.read.parquet(f"{path}/steps").withColumn("file", F.col("_metadata.file_path"))
    samples = steps.where((F.col("step") % every == 0)).select("walk", "step", "start", "file")
    samples.sortWithinPartitions("walk", "start").write.mode("overwrite").parquet(f"{path}/samples")
    extents = steps.groupBy("walk", "file").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("step").alias("first"), F.max("step").alias("last"))
    extents.write.mode("overwrite").parquet(f"{path}/extents")


class PositionIndex:
    """The tables below a path that write() filled."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.samples, self.extents = spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/extents")

    def seek(self, targets: DataFrame, size: int = blocks.PLACES) -> DataFrame:
        """(walk, target, step, start): the last sample at or before each of targets(walk, target); no step is read."""
        return coords.last_samples(self.samples.select("walk", "step", "start"), targets, size)

    def steps_of(self, files: DataFrame) -> DataFrame:
        """The steps of files(file), a table of names that comes to the driver; none other is opened."""
        names = [r[0] for r in files.select("file").distinct().limit(MOST_FILES + 1).collect()]
        if len(names) > MOST_FILES:
            raise ValueError(f"a lookup in over {MOST_FILES} files: ask for fewer places at a time, or use the whole table of steps")
        whole = self.spark.read.parquet(f"{self.path}/steps")
        return self.spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)

    def overlaps(self, regions: DataFrame, bucket: int = 256) -> DataFrame:
        """As coords.region_overlaps, of regions(region, walk, lo, hi)."""
        asked = self.extents.withColumnsRenamed({"lo": "from", "hi": "to"}).join(regions.where("hi > lo"), "walk")
        return coords.placed_overlaps(self.steps_of(asked.where((F.col("from") < F.col("hi")) & (F.col("to") > F.col("lo")))), regions, bucket)

    def at(self, targets: DataFrame) -> DataFrame:
        """(walk, target, step, node, fwd, offset): the step that holds each place, and how far into its node that is."""
        regions = targets.select(F.struct("walk", "target").alias("region"), "walk", F.col("target").alias("lo"), (F.col("target") + 1).alias("hi"))
        return self.overlaps(regions).select("region.walk", "region.target", "step", "node", "fwd", (F.col("region.target") - F.col("start")).alias("offset"))
