"""Whole queries: from graph text to scores, coordinates, sequences and features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import assembly_matches, plain_contig, three_field_name
from ..operators import coords, graph, index, intervals, krylov, sequence, snarls, spectral, windows
from ..sources import bundles, gfa, sinks

#: Names of reference samples in the order they are tried.
ASSEMBLIES = ("grch38", "chm13", "hg38", "t2t", "")


def bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes(name, seq, len, node), edges(src, dst), links(src, src_fwd, dst, dst_fwd), walks(walk, step, node, fwd, len) and paths(walk, sample, contig...)."""
    rows = gfa.lines(spark, path)
    segs = gfa.segments(rows)
    idx = index.node_index(segs.select("name"))
    # of segments of one name the first in byte order counts, one with a sequence before one without
    once = segs.groupBy("name").agg(F.min("seq").alias("seq"))
    nodes = once.join(idx, "name").select("name", "seq", F.coalesce(F.length("seq"), F.lit(0)).cast("bigint").alias("len"), F.col("idx").alias("node"))
    links = index.index_edges(gfa.links(rows), idx)
    steps = gfa.path_steps(rows).unionByName(gfa.walk_steps(rows).select("walk", "step", "name", "fwd"))
    names = index.stored(steps.select("walk").distinct().select("walk", three_field_name(F.col("walk")).alias("named")))
    named = steps.join(names, "walk").drop("walk").withColumnRenamed("named", "walk")
    walks = named.join(nodes.select("name", "node", "len"), "name").select("walk", "step", "node", "fwd", "len")
    return {"nodes": nodes, "edges": links.select("src", "dst"), "links": links, "walks": walks, "paths": gfa.path_names(names.select(F.col("named").alias("walk")).distinct())}


def convert(spark: SparkSession, path: str, out: str) -> None:
    """Graph text to an edge table laid out by source node, and to laid-out graph tables."""
    parts = bundle(spark, path)
    sinks.edges(parts["edges"], f"{out}/edges")
    bundles.write(parts, out)


def resolve(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """The graph tables below out: those that are there, or else made from graph text."""
    if not bundles.exists(spark, out):
        convert(spark, path, out)
    return bundles.read(spark, out)


def extract(edges: DataFrame, start: int, end: int) -> dict[str, DataFrame]:
    """Laplacian, spectrum and score of the nodes from start to end, both included."""
    inside = graph.in_range(edges, start, end)
    coo = graph.laplacian(inside, loops="degree").withColumn("win", F.lit(start).cast("bigint"))
    spectrum = spectral.spectra(coo, "win")
    return {"laplacian": coo.drop("win"), "spectrum": spectrum, "score": spectral.score_of_spectrum(spectrum, "win")}


def window_scores(edges: DataFrame, start: int, end: int, size: int, overlap: int, exact: bool = True) -> DataFrame:
    """(start_node, end_node, ngec) of every node window that has an edge."""
    coo = windows.window_laplacians(edges, start, end, size, overlap)
    return spectral.block_scores(coo, "win", exact).select(F.col("win").alias("start_node"), (F.col("win") + size).alias("end_node"), F.col("score").alias("ngec"))


def reference_walks(walks: DataFrame, paths: DataFrame, contig: str | None, assemblies: Sequence[str] = ASSEMBLIES) -> DataFrame:
    """The walks over a contig (over any, for None) of the first assembly that has one, with their ``fragment``: where
    on the contig they start."""
    on = paths if contig is None else paths.where(plain_contig(F.col("contig")) == contig)
    for name in assemblies:
        found = on.where(assembly_matches(F.col("sample"), name))
        if not found.isEmpty():
            return walks.join(found.select("walk", "fragment"), "walk")
    return walks.withColumn("fragment", F.lit(None).cast("bigint")).limit(0)


def parse(region: str) -> tuple[str, int, int]:
    """(contig, start, end), 0-based half-open; as functions.scalars.region."""
    contig, _, span = region.partition(":")
    s, _, e = span.partition("-")
    if not (s.isdigit() and e.isdigit()) or int(e) < int(s):
        raise ValueError(f"not a region: {region}")
    return (contig, 0, int(e) + 1) if int(s) == 0 else (contig, int(s) - 1, int(e))


def coord2node(parts: dict[str, DataFrame], region: str, assemblies: Sequence[str] = ASSEMBLIES) -> DataFrame:
    """The steps of the reference walks that meet a region; start and end are places on the contig."""
    contig, start, end = parse(region)
    return coords.overlaps(reference_walks(parts["walks"], parts["paths"], contig, assemblies), start, end, "fragment").drop("fragment")


def extracted_ratio(parts: dict[str, DataFrame], region: str, assemblies: Sequence[str] = ASSEMBLIES) -> DataFrame:
    """(walk, bases, ratio): what each reference walk holds of a region, and its share of the region's length."""
    _, start, end = parse(region)
    inside = coord2node(parts, region, assemblies).groupBy("walk").agg(F.sum(F.col("off_end") - F.col("off_start")).alias("bases"))
    return inside.withColumn("ratio", F.col("bases") / (end - start))


def node2coord(parts: dict[str, DataFrame], nodes: DataFrame, assemblies: Sequence[str] = ASSEMBLIES) -> DataFrame:
    """Where nodes(node) lie on the contigs of reference walks; of any walk where there is no reference."""
    return coords.node_to_coordinates(reference_walks(parts["walks"], parts["paths"], None, assemblies), nodes, "fragment")


def node_report(hits: DataFrame) -> DataFrame:
    """(walk, steps, nodes, low, high, ranges) of a coord2node result."""
    facts = hits.groupBy("walk").agg(F.count("*").alias("steps"), F.countDistinct("node").alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high"))
    return facts.join(intervals.id_ranges(hits, ["walk"], "node"), "walk")


def anchored_walks(parts: dict[str, DataFrame], region: str, assemblies: Sequence[str] = ASSEMBLIES, slack: int = 50_000) -> DataFrame:
    """Of every walk the steps between the region's first and last reference node, within reach of the first.

    Of several fragments of reference walks that meet the region the longest is taken, and of those the first by name. A walk that
    leaves the reach starts anew; all complete walks are returned. Reach goes along links as walks may.
    """
    contig, start, end = parse(region)
    on = reference_walks(parts["walks"], parts["paths"], contig, assemblies)
    met = coords.anchors(on, start, end, "fragment").join(coords.lengths(on).select("walk", "length"), "walk")
    ends = met.orderBy(F.desc("length"), "walk").limit(1).select(F.col("first.node").alias("first"), F.col("last.node").alias("last")).collect()
    if not ends:
        return parts["walks"].limit(0).select("walk", "step", "node", "fwd")
    first, last = ends[0]["first"], ends[0]["last"]
    near = coords.oriented_reach(parts["links"], parts["nodes"].select("node", "len"), parts["nodes"].where(F.col("node") == first).select("node"), end - start + slack, last)
    return coords.between_anchors(parts["walks"], first, last, near)


def make_sequence(parts: dict[str, DataFrame], region: str, assemblies: Sequence[str] = ASSEMBLIES) -> DataFrame:
    """(file, record): FASTA of the region on every walk over the contig; nodes without a sequence give N."""
    contig, start, end = parse(region)
    on = reference_walks(parts["walks"], parts["paths"], contig, ("",))
    hits = coords.overlaps(on, start, end, "fragment")
    built = sequence.assembled(hits, parts["nodes"].where("seq is not null").select("node", "seq"))
    return sequence.fasta(built.select(F.col("walk").alias("name"), "seq"), start, end)


def region_score(parts: dict[str, DataFrame], region: str, exact: bool = True) -> DataFrame:
    """(region, nodes, score) of the subgraph of a region: edges once, loops left out.

    A region beyond one task is scored by random probes over tables; an exact score of it is refused.
    """
    nodes = coord2node(parts, region).select("node").distinct()
    coo = index.stored(graph.laplacian(graph.within(parts["edges"], nodes), loops="skip", multi="drop"))
    small = coo.select("row").distinct().count() <= spectral.FULL_ORDER
    if not small and exact:
        raise ValueError(f"an exact score of a region of over {spectral.FULL_ORDER} nodes; ask for random probes")
    scores = spectral.block_scores(coo.withColumn("win", F.lit(0).cast("bigint")), "win", exact, degree=64, probes=24) if small else krylov.probe_score(coo)
    return scores.select(F.lit(region).alias("region"), "nodes", "score")


def feature_matrix(walks: DataFrame, topology: DataFrame) -> DataFrame:
    """(walk, feature, value) of walks over a topology."""
    return snarls.encoded(walks, topology)


def list_walks(parts: dict[str, DataFrame]) -> DataFrame:
    return parts["paths"].join(coords.lengths(parts["walks"]), "walk").select("walk", "sample", "phase", "contig", "fragment", "length", "steps")


def name_counts(paths: DataFrame) -> DataFrame:
    """(samples, haplotypes, contigs): how many different ones paths(sample, phase, contig, ...) name."""
    return paths.agg(F.countDistinct("sample").alias("samples"), F.countDistinct(F.struct("sample", "phase")).alias("haplotypes"), F.countDistinct("contig").alias("contigs"))


def lowest_eigenpairs(edges: DataFrame, start: int, end: int, k: int = 10) -> DataFrame:
    """(k, eigenvalue, residual, node, entry): the smallest eigenpairs of a node range, in one task up to FULL_ORDER nodes,
    by a Krylov space over tables beyond. The residual is the length of M v - value v, which tells how far that went."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, values, vectors = spectral.smallest(pdf, k)
        at, left = np.arange(len(values)), np.linalg.norm(spectral.Entries(pdf) @ vectors - vectors * values, axis=0)
        return pd.DataFrame({"k": np.repeat(at, len(nodes)), "eigenvalue": np.repeat(values, len(nodes)), "residual": np.repeat(left, len(nodes)), "node": np.tile(nodes, len(values)), "entry": vectors.T.ravel()})

    coo = index.stored(graph.laplacian(graph.in_range(edges, start, end)))
    if coo.select("row").distinct().count() > spectral.FULL_ORDER:
        values, vectors = krylov.lowest(coo, k)
        return values.join(vectors, "k").select("k", "eigenvalue", "residual", "node", "entry")
    return coo.groupBy(F.lit(0).alias("__block")).applyInPandas(solve, "k long, eigenvalue double, residual double, node long, entry double")


def lowest_eigenvalues(edges: DataFrame, start: int, end: int, k: int = 10) -> DataFrame:
    """(k, eigenvalue, residual) of lowest_eigenpairs."""
    return lowest_eigenpairs(edges, start, end, k).groupBy("k").agg(F.first("eigenvalue").alias("eigenvalue"), F.first("residual").alias("residual"))
