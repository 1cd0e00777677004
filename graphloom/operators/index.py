"""Dense node indices without a single-partition sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_rank(df: DataFrame, *keys: str | Column, name: str = "idx") -> DataFrame:
    """Adds 0-based positions in the order of keys.

    Rows are dealt by range and sorted within partitions; only one count for each partition comes to the driver, and
    the offsets go back as a table of as many rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at"))
    placed = kept(placed)
    start, offsets = 0, []
    for part, n in sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()):
        offsets.append((part, start))
        start += n
    before = spark.createDataFrame(offsets or [(-1, 0)], "__part int, __before long")
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As kept, as a table: for frames that are joined with themselves or read column by column."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """As stored, in buckets of the columns: joins and groups by them need no exchange of this side."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, *columns).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; found and its files stay
    return found


def node_index(names: DataFrame, numeric: bool = True) -> DataFrame:
    """(name, idx): dense ranks of the distinct names of a one-column frame.

    Names that are all 32-bit numbers are ordered as numbers when ``numeric``, otherwise as bytes.
    """
    (name,) = names.columns
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    if numeric and dict(distinct.dtypes)["name"] == "string":
        from ..functions.scalars import strict_u32

        if distinct.where(strict_u32(F.col("name")).isNull()).isEmpty():
            return with_rank(distinct, strict_u32(F.col("name")), "name")
    return with_rank(distinct, "name")


def contiguous_index(ids: DataFrame) -> DataFrame:
    """(id, idx) by subtraction where the ids have no gap; by rank where they have."""
    (name,) = ids.columns
    distinct = ids.select(F.col(name).alias("id")).distinct()
    low, high, n = distinct.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if n and high - low + 1 == n:
        return distinct.withColumn("idx", F.col("id") - low)
    return with_rank(distinct, "id")


def index_edges(links: DataFrame, index: DataFrame) -> DataFrame:
    """links(src, dst, ...) by name with both ends as indices; links with an unknown end are dropped."""
    src = index.select(F.col("name").alias("src"), F.col("idx").alias("__a"))
    dst = index.select(F.col("name").alias("dst"), F.col("idx").alias("__b"))
    return links.join(src, "src").join(dst, "dst").withColumns({"src": F.col("__a"), "dst": F.col("__b")}).select(*links.columns)
