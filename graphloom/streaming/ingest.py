"""Edges from a growing folder of graph text, kept as running degrees and entropy windows.

Files are read as they arrive, each once; the running table is Structured Streaming state, checkpointed in the folder
given. A bounded folder can be drained with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..sources import gfa


def link_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """links(src, dst) by name of the files of a folder."""
    text = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = text.where(F.startswith("value", F.lit("L\t"))).select(F.lit("L").alias("kind"), F.split("value", "\t", -1).alias("fields"))
    return gfa.links(rows).select("src", "dst")


def degree_stream(links: DataFrame) -> DataFrame:
    """(node, degree) so far."""
    return graph.degrees(links)


def run(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Drains what is there into an in-memory table; for tests and small results."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_edges(links: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends links to a Parquet table; a file that was read before is not written again."""
    return links.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
