"""Edges, degrees and graph Laplacians as coordinate lists (row, col, value).

Edges are frames (src, dst), with the grouping keys of ``by`` in front where there are any (for example a window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def canonical(edges: DataFrame) -> DataFrame:
    """Each edge with its lesser end first."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def distinct_edges(edges: DataFrame) -> DataFrame:
    return canonical(edges).distinct()


def in_range(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Edges with both ends in [start, end]; the comparison reaches a Parquet scan."""
    return edges.where(F.col("src").between(start, end) & F.col("dst").between(start, end))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def step_pairs(walks: DataFrame, size: int = blocks.STEPS) -> DataFrame:
    """Consecutive steps of walks(walk, step, node, fwd): walk, step, src, src_fwd, dst, dst_fwd."""
    pairs = blocks.following(walks.select("walk", "step", "node", "fwd"), ["walk"], "step", "node", "fwd", size=size)
    named = pairs.select("walk", "step", F.col("node").alias("src"), F.col("fwd").alias("src_fwd"), F.col("next.node").alias("dst"), F.col("next.fwd").alias("dst_fwd"))
    return named.where("dst is not null")


def transitions(walks: DataFrame, size: int = blocks.STEPS) -> DataFrame:
    """How often each oriented pair is walked, in both directions of every walk: a pair read backwards is its ends
    swapped and turned, so the walks are paired once."""
    from ..functions.scalars import oriented

    def pair(a: str, a_fwd, b: str, b_fwd):
        return F.struct(oriented(F.col(a), a_fwd).alias("from_node"), oriented(F.col(b), b_fwd).alias("to_node"))

    src, dst = F.col("src_fwd"), F.col("dst_fwd")
    both = step_pairs(walks, size).select(F.explode(F.array(pair("src", src, "dst", dst), pair("dst", ~dst, "src", ~src))).alias("p"))
    return both.groupBy("p.from_node", "p.to_node").agg(F.count("*").alias("n"))


def both_directions(walks: DataFrame) -> DataFrame:
    """Walks and their reverses, told apart by the column ``reverse``; walk is that pair's key."""
    ends_at = walks.groupBy("walk").agg(F.max("step").alias("__last"))
    turned = walks.join(ends_at, "walk").select("walk", (F.col("__last") - F.col("step")).alias("step"), "node", (~F.col("fwd")).alias("fwd"))

    def marked(w: DataFrame, reverse: bool) -> DataFrame:
        return w.select(F.struct("walk", F.lit(reverse).alias("reverse")).alias("walk"), "step", "node", "fwd")

    return marked(walks.select("walk", "step", "node", "fwd"), False).unionByName(marked(turned, True))


def ends(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.select(*by, F.col("src").alias("node")).unionByName(edges.select(*by, F.col("dst").alias("node")))


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, degree): a loop counts twice."""
    return ends(edges, by).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """0/1 and symmetric: (row, col, value)."""
    pairs = edges.select(F.explode(F.array(F.struct(F.col("src").alias("row"), F.col("dst").alias("col")), F.struct(F.col("dst").alias("row"), F.col("src").alias("col")))).alias("e"))
    return pairs.select("e.row", "e.col").distinct().withColumn("value", F.lit(1).cast("bigint"))


def laplacian(edges: DataFrame, loops: str = "cancel", multi: str = "keep", by: Sequence[str] = ()) -> DataFrame:
    """(row, col, value) of D - A, zeros left out.

    loops: ``cancel`` nets a loop to 0, ``degree`` leaves its 2 on the diagonal, ``skip`` ignores it. multi: ``keep``
    adds repeated edges, ``drop`` counts an undirected edge once. Pairs of ends are counted once, in either direction, and
    ends by node; what is shuffled is a row a pair, and the ends that a task has counted (for ``drop``, those of pairs).
    ``keep`` reads edges twice.
    """
    src, dst = F.col("src"), F.col("dst")
    used = canonical(edges).select(*by, "src", "dst") if multi == "drop" else edges.select(*by, "src", "dst")
    if loops == "skip":
        used = used.where("src <> dst")
    first = src.isNull() | F.coalesce(src <= dst, F.lit(False))
    pairs = used.select(*by, F.when(first, src).otherwise(dst).alias("src"), F.when(first, dst).otherwise(src).alias("dst"))
    pairs = pairs.groupBy(*by, "src", "dst").agg((F.lit(1).cast("bigint") if multi == "drop" else F.count("*")).alias("n"))
    off = pairs.where(~src.eqNullSafe(dst))
    both = F.array(F.struct(src.alias("row"), dst.alias("col")), F.struct(dst.alias("row"), src.alias("col")))
    off = off.select(*by, F.explode(both).alias("e"), (-F.col("n")).alias("value")).select(*by, "e.row", "e.col", "value")
    counted = pairs if multi == "drop" else used.withColumn("n", F.lit(1).cast("bigint"))
    counted = counted.where(~src.eqNullSafe(dst) | (src == dst)) if loops == "degree" else counted.where(~src.eqNullSafe(dst))
    counted = counted.select(*by, F.explode(F.array("src", "dst")).alias("row"), "n").groupBy(*by, "row").agg(F.sum("n").alias("value"))
    return off.unionByName(counted.select(*by, "row", F.col("row").alias("col"), "value"))


def normalized_laplacian(edges: DataFrame) -> DataFrame:
    """(row, col, value) of I - D^-1/2 A D^-1/2 for the simple graph of edges."""
    simple = distinct_edges(edges).where("src <> dst")
    deg = degrees(simple)
    both = adjacency(simple)
    off = both.join(deg.select(F.col("node").alias("row"), F.col("degree").alias("dr")), "row").join(deg.select(F.col("node").alias("col"), F.col("degree").alias("dc")), "col")
    return off.select("row", "col", (-1 / F.sqrt(F.col("dr") * F.col("dc"))).alias("value")).unionByName(deg.select(F.col("node").alias("row"), F.col("node").alias("col"), F.lit(1.0).alias("value")))


def row_pointers(coo: DataFrame, size: int) -> DataFrame:
    """(row, ptr) of compressed sparse rows, 0 to size inclusive; rows without an entry repeat the pointer."""
    spark = coo.sparkSession
    counts = spark.range(size + 1).select(F.col("id").alias("row")).join(coo.groupBy(F.col("row") + 1).count().toDF("row", "n"), "row", "left")
    return running_total(counts.select("row", F.coalesce("n", F.lit(0)).alias("n")), "row", "n", "ptr")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Inclusive running sums over a whole table, by range partitions and one offset for each."""
    from .index import kept

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(df.select(order, value).repartitionByRange(parts, order).select("*", F.spark_partition_id().alias("__part")))
    start, offsets = 0, []
    for part, total in sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(F.sum(value)).collect()):
        offsets.append((part, start))
        start += total
    before = F.broadcast(spark.createDataFrame(offsets or [(-1, 0)], "__part int, __before long"))
    inside = Window.partitionBy("__part").orderBy(order)
    return placed.join(before, "__part").select(order, (F.sum(value).over(inside) + F.col("__before")).alias(name))


def trace_and_bound(coo: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trace, and the largest absolute row sum (1 at least), an upper bound of the spectrum."""
    rows = coo.groupBy(*by, "row").agg(F.sum(F.when(F.col("row") == F.col("col"), F.col("value")).otherwise(0)).alias("d"), F.sum(F.abs("value")).alias("s"))
    return rows.groupBy(*by).agg(F.sum("d").alias("trace"), F.greatest(F.max("s").cast("double"), F.lit(1.0)).alias("bound"))


def matvec(coo: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value) of a matrix times vector(node, x)."""
    return coo.join(vector.select(F.col("node").alias("col"), "x"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def shape_report(coo: DataFrame) -> DataFrame:
    """Entries, rows with one, bandwidth, and entries without their mirror image."""
    mirror = coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    odd = coo.join(mirror, ["row", "col", "value"], "left_anti").agg(F.count("*").alias("asymmetric"))
    facts = coo.agg(F.count("*").alias("entries"), F.countDistinct("row").alias("rows"), F.max(F.abs(F.col("row") - F.col("col"))).alias("bandwidth"))
    return facts.join(odd, F.lit(True))  # one row each
