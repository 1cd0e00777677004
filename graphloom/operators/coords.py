"""Linear coordinates of walks: walks(walk, step, node, fwd, len) and what regions of them hold.

Offsets are a running sum within a walk, in blocks of steps (see blocks): a walk of any length is many tasks, and
nothing of a walk is collected. ``size`` is the number of steps, or of places, of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .index import kept


def offsets(walks: DataFrame, size: int = blocks.STEPS, base: str | None = None) -> DataFrame:
    """Adds start and end, half-open, of each step along its walk; from where the column ``base`` says, if it is named
    (a null counts as 0), so that fragments of a contig lie where they belong."""
    summed = blocks.running(walks, ["walk"], ["step"], F.col("len"), "start", before=True, size=size)
    first = F.lit(0) if base is None else F.coalesce(base, F.lit(0))
    return summed.withColumn("start", F.coalesce("start", F.lit(0)) + first).withColumn("end", F.col("start") + F.col("len"))


def lengths(walks: DataFrame) -> DataFrame:
    return walks.groupBy("walk").agg(F.sum("len").alias("length"), F.count("*").alias("steps"), F.countDistinct("node").alias("nodes"))


def node_to_coordinates(walks: DataFrame, nodes: DataFrame, base: str | None = None) -> DataFrame:
    """(walk, node, start, last): every occurrence of nodes(node); last is inclusive."""
    return offsets(walks, base=base).join(nodes, "node", "left_semi").select("walk", "node", "start", (F.col("end") - 1).alias("last"))


def overlaps(walks: DataFrame, start: int, end: int, base: str | None = None) -> DataFrame:
    """Steps that meet [start, end) of their walk, with the part of the node that lies inside, as the walk sees it."""
    hit = offsets(walks, base=base).where((F.col("start") < end) & (F.col("end") > start))
    return hit.withColumns({"off_start": F.greatest(F.lit(start) - F.col("start"), F.lit(0)), "off_end": F.least(F.lit(end), F.col("end")) - F.col("start")})


def region_overlaps(walks: DataFrame, regions: DataFrame, bucket: int = 256) -> DataFrame:
    """As overlaps, for many regions(region, walk, lo, hi): an equi-join on (walk, bucket of coordinates)."""
    return placed_overlaps(offsets(walks), regions, bucket)


def placed_overlaps(placed: DataFrame, regions: DataFrame, bucket: int = 256) -> DataFrame:
    """region_overlaps of steps that have their start and end."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor((b - 1) / bucket)))
    (cell,) = blocks.fresh(placed.select(*placed.columns, *(F.lit(0).alias(c) for c in regions.columns if c not in placed.columns)), "bucket")
    steps = placed.where("len > 0").withColumn(cell, buckets(F.col("start"), F.col("end")))
    asked = regions.where("hi > lo").withColumn(cell, buckets(F.col("lo"), F.col("hi")))
    met = steps.join(asked, ["walk", cell]).where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))
    # a pair is kept in the first bucket both are in
    first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("lo") / bucket))
    met = met.where(F.col(cell) == first).drop(cell)
    return met.withColumns({"off_start": F.greatest(F.col("lo") - F.col("start"), F.lit(0)), "off_end": F.least("hi", "end") - F.col("start")})


def seek(walks: DataFrame, targets: DataFrame, every: int = 10, size: int = blocks.PLACES) -> DataFrame:
    """(walk, target, step, start): the last sampled step (every so many) that starts at or before a target."""
    return last_samples(offsets(walks).where(F.col("step") % every == 0).select("walk", "step", "start"), targets, size)


def last_samples(samples: DataFrame, targets: DataFrame, size: int = blocks.PLACES) -> DataFrame:
    """seek in samples(walk, step, start) that are there already."""
    placed = samples.select("walk", F.col("start").alias("at"), F.lit(0).alias("kind"), "step", "start", F.lit(None).cast("bigint").alias("target"))
    asked = targets.select("walk", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("step"), F.lit(None).cast("bigint").alias("start"), "target")
    # samples come before targets of the same place; the last sample before a target is carried forward
    both = placed.unionByName(asked).withColumn("sample", F.when(F.col("kind") == 0, F.struct("step", "start")))
    carried = blocks.carried(both, ["walk"], ["at", "kind", "step"], F.col("sample"), "found", size=size)
    return carried.where("kind = 1").select("walk", "target", "found.step", "found.start")


def anchors(walks: DataFrame, start: int, end: int, base: str | None = None) -> DataFrame:
    """First and last step of each walk that meet a region, with the part of each node that lies inside."""
    hit = overlaps(walks, start, end, base)
    row = F.struct("step", "node", "fwd", "len", "off_start", "off_end")
    return hit.groupBy("walk").agg(F.min_by(row, "step").alias("first"), F.max_by(row, "step").alias("last"))


def forward_offsets(hits: DataFrame) -> DataFrame:
    """off_start and off_end on the node's forward strand."""
    from ..functions.scalars import anchor_offsets

    a, b = anchor_offsets(F.col("len"), F.col("fwd"), F.col("off_start"), F.col("off_end"))
    return hits.withColumns({"fwd_start": a, "fwd_end": b})


def between_anchors(walks: DataFrame, first: int, last: int, reach: DataFrame | None = None, size: int = blocks.STEPS) -> DataFrame:
    """The steps of each walk from a visit of node ``first`` to the next visit of ``last``: its earliest such stretch.

    With reach(node), a walk that leaves these nodes starts anew: a stretch lies within one run of steps inside. Further
    visits of ``first`` on the way do not start anew. Walks without a complete stretch give no rows; all complete walks
    are returned.
    """
    inside = walks.withColumn("run", F.lit(0).cast("bigint"))
    if reach is not None:
        marked = walks.join(reach.select("node", F.lit(True).alias("inside")).distinct(), "node", "left")
        outside = F.when(F.col("inside").isNull(), 1).otherwise(0)
        inside = blocks.running(marked, ["walk"], ["step"], outside, "run", size=size).where("inside")
    begins = inside.where(F.col("node") == first).groupBy("walk", "run").agg(F.min("step").alias("begin"))
    ends = inside.where(F.col("node") == last).select("walk", "run", "step").join(begins, ["walk", "run"]).where("step >= begin")
    stretch = ends.groupBy("walk").agg(F.min(F.struct(F.col("step").alias("stop"), "begin")).alias("s"))
    found = walks.join(stretch.select("walk", "s.begin", "s.stop"), "walk").where(F.col("step").between(F.col("begin"), F.col("stop")))
    return found.select("walk", "step", "node", "fwd")


def candidate_walks(walks: DataFrame, names: DataFrame, node: int, sample: str, contig: str) -> DataFrame:
    """(walk, tier): walks through a node of a sample and contig (0); where there are none, of the sample alone (1)."""
    from ..functions.scalars import of_sample, plain_contig

    through = names.join(walks.where(F.col("node") == node).select("walk"), "walk", "left_semi")
    tiered = through.where(of_sample(F.col("name"), F.lit(sample))).withColumn("tier", F.when(plain_contig(F.col("name")) == contig, 0).otherwise(1))
    best = tiered.agg(F.min("tier").alias("best"))
    return tiered.join(F.broadcast(best), F.col("tier") == F.col("best")).select("walk", "tier")


def bounded_reach(edges: DataFrame, lengths_of: DataFrame, sources: DataFrame, cap: int, stop: int | None = None) -> DataFrame:
    """(node, cost): least bases before a node over paths from sources(node), up to cap, not going on from ``stop``.

    Edges are gone along in both directions, whatever their orientation.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    steps = both.join(lengths_of.select(F.col("node").alias("src"), "len"), "src")
    return _spread(steps, sources.select("node"), cap, None if stop is None else F.col("node") != stop)


def oriented_reach(links: DataFrame, lengths_of: DataFrame, sources: DataFrame, cap: int, stop: int | None = None) -> DataFrame:
    """As bounded_reach over links(src, src_fwd, dst, dst_fwd), as walks may go: a node is left on the strand it is
    entered on. Sources are entered on both strands; a link is gone along as it stands, or back on the other strands.
    Nodes of no length are neither reached nor gone on from. The cost of a node is the lesser of its strands.
    """
    from ..functions.scalars import oriented

    ahead = links.select(oriented(F.col("src"), F.col("src_fwd")).alias("src"), oriented(F.col("dst"), F.col("dst_fwd")).alias("dst"))
    back = links.select(oriented(F.col("dst"), ~F.col("dst_fwd")).alias("src"), oriented(F.col("src"), ~F.col("src_fwd")).alias("dst"))
    real = lengths_of.where("len > 0").select("node", "len")
    steps = ahead.unionByName(back).distinct().withColumn("node", F.shiftright("src", 1)).join(real, "node").select("src", "dst", "len")
    begin = sources.join(real, "node", "left_semi").select(F.explode(F.array(F.shiftleft("node", 1), F.shiftleft("node", 1) + 1)).alias("node"))
    found = _spread(steps, begin, cap, None if stop is None else F.shiftright("node", 1) != stop)
    return found.groupBy(F.shiftright("node", 1).alias("node")).agg(F.min("cost").alias("cost")).join(real, "node", "left_semi")


def _spread(steps: DataFrame, sources: DataFrame, cap: int, goes_on: Column | None) -> DataFrame:
    """(node, cost) over steps(src, dst, len). One frontier join and one combinable minimum a round, each round cut into
    the shared folder."""
    reached = kept(sources.select("node", F.lit(0).cast("bigint").alias("cost")).distinct())
    frontier, steps = reached, kept(steps)
    while True:
        on = frontier if goes_on is None else frontier.where(goes_on)
        found = on.join(steps, on["node"] == steps["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("len")).alias("cost")).where(F.col("cost") <= cap).groupBy("node").agg(F.min("cost").alias("new"))
        joined = kept(reached.join(found, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("moved")))
        reached = joined.select("node", "cost")
        frontier = joined.where("moved").select("node", "cost")
        if frontier.isEmpty():
            return reached


def capped(walks: DataFrame, nodes: int, bases: int, size: int = blocks.STEPS) -> DataFrame:
    """The steps of each walk up to a number of nodes and of bases."""
    counted = blocks.running(walks, ["walk"], ["step"], F.lit(1), "seen", size=size)
    summed = blocks.running(counted, ["walk"], ["step"], F.col("len"), "sum", size=size)
    return summed.where((F.col("seen") <= nodes) & (F.col("sum") <= bases)).drop("seen", "sum")
