"""A graph as a folder of laid-out tables, and a loader that counts the rules they break.

nodes and links lie in buckets of nodes (links of their source); steps lie twice, in buckets of walks and of nodes, so
that joins and groups by either need no exchange. The number of buckets stands in the folder, so any session can read
the layout back.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each table, what it holds of a bundle, and the column of its buckets.
LAYOUT = {"nodes": ("nodes", "node"), "links": ("links", "src"), "walks": ("walks", "walk"), "visits": ("walks", "node"), "paths": ("paths", "walk")}


class BundleError(ValueError):
    """A bundle that breaks rules, or a folder without one."""


def write(parts: dict[str, DataFrame], path: str, buckets: int | None = None) -> None:
    """nodes, links, walks and paths of plans.pipelines.bundle below path; over what was there."""
    spark = parts["nodes"].sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for folder, (part, column) in LAYOUT.items():
        df = parts[part]
        order = [column, *(c for c in ("step", "dst") if c in df.columns)]
        name = f"bundle_{uuid.uuid4().hex}"
        df.repartition(buckets, column).write.mode("overwrite").option("path", f"{path}/{folder}").bucketBy(buckets, column).sortBy(*order).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the name only
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole bundle is there: its layout is written last."""
    try:
        return not spark.read.schema("buckets int").json(f"{path}/layout").isEmpty()
    except AnalysisException:
        return False


def read(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """nodes, edges, links, walks, visits (the steps of walks, by node) and paths, each with its layout; refuses a
    bundle that breaks a rule unless check is False."""
    if not exists(spark, path):
        raise BundleError(f"no graph tables below {path}")
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    parts = {}
    for folder, (_, column) in LAYOUT.items():
        schema = spark.read.parquet(f"{path}/{folder}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        name = f"bundle_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'")
        parts[folder] = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name only
    parts["edges"] = parts["links"].select("src", "dst")
    if check:
        broken = [f"{r['rule']}: {r['broken']}" for r in broken_rules(parts).where("broken > 0").orderBy("rule").collect()]
        if broken:
            raise BundleError("; ".join(broken))
    return parts


def broken_rules(parts: dict[str, DataFrame]) -> DataFrame:
    """(rule, broken): how many nodes, links, steps, walks or names break each rule. One job; each table is read as it
    lies, and only the far ends of links are exchanged."""
    nodes, links, walks, visits, paths = (parts[k] for k in ("nodes", "links", "walks", "visits", "paths"))

    def count(rule: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")

    numbers = nodes.agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    of_walk = walks.groupBy("walk").agg(F.count("*").alias("n"), F.min("step").alias("low"), F.max("step").alias("high"), F.countDistinct("step").alias("steps"))
    known = nodes.select("node", F.col("len").alias("real"))
    visited = visits.join(known, "node", "left")
    near = links.join(known, links["src"] == known["node"], "left_anti")
    far = links.join(known, links["dst"] == known["node"], "left_anti")
    named = paths.groupBy("walk").agg(F.count("*").alias("names"))
    both = of_walk.select("walk", "n").join(named, "walk", "full")
    rules = [
        count("nodes are numbered from 0 without a gap", numbers.where("n > 0 and (low <> 0 or high <> n - 1)")),
        count("a node is there once", nodes.groupBy("node").count().where("count > 1")),
        count("a node is as long as its sequence", nodes.where("seq is not null and len <> length(seq) or len < 0 or len is null")),
        count("a link starts at a node", near),
        count("a link ends at a node", far),
        count("steps are numbered from 0 without a gap", of_walk.where("low <> 0 or high <> n - 1 or steps <> n")),
        count("a step is on a node", visited.where("real is null")),
        count("a step is as long as its node", visited.where("real is not null and not (len <=> real)")),
        count("a walk has one name, and a name a walk", both.where("n is null or names is null or names > 1")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out
