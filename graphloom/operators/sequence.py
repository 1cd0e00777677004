"""Sequences of nodes and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chunks, file_safe, oriented_slice, region_text, wrapped


def of_nodes(sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """sequences(node, seq) of the nodes asked for."""
    return sequences.join(nodes, "node", "left_semi")


def with_fallback(nodes: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """nodes(node, len) with the sequence of the first source that has it, or N for every base."""
    a, b = first.select("node", F.col("seq").alias("a")), second.select("node", F.col("seq").alias("b"))
    return nodes.join(a, "node", "left").join(b, "node", "left").select("node", "len", F.coalesce("a", "b", F.expr("repeat('N', int(len))")).alias("seq"))


def assembled(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """(walk, seq): the oriented parts of hits(walk, step, node, fwd, len, off_start, off_end) in the order of steps.

    off_end is exclusive. A node without a sequence gives N.
    """
    joined = hits.join(sequences.select("node", "seq"), "node", "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('N', int(len))")))
    piece = oriented_slice(F.col("seq"), F.col("fwd"), F.col("off_start"), F.col("off_end"))
    parts = joined.groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("step", piece.alias("piece")))).alias("p"))
    return parts.select("walk", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def fasta(named: DataFrame, start: int, end: int) -> DataFrame:
    """(file, record) of named(name, seq): header and lines of 60 bases, one record for a walk."""
    where = region_text(F.lit(start), F.lit(end))
    header = F.concat(F.lit(">"), F.col("name"), F.lit(":"), where)
    return named.select(F.concat(file_safe(F.col("name")), F.lit("_"), where, F.lit(".fa")).alias("file"), F.concat(header, F.lit("\n"), wrapped(F.col("seq"))).alias("record"))


def chunked(segments: DataFrame) -> DataFrame:
    """(name, chunk, seq): segments cut into nodes of 1024 bases."""
    return segments.select("name", F.posexplode(chunks(F.col("seq"))).alias("chunk", "seq"))


def expanded_steps(walks: DataFrame, chunk_index: DataFrame) -> DataFrame:
    """Walks over names as walks over chunk nodes(name, chunk, node): a reverse step runs through its chunks backwards."""
    last = chunk_index.groupBy("name").agg(F.max("chunk").alias("last"))
    joined = walks.join(chunk_index.join(last, "name"), "name")
    part = F.when(F.col("fwd"), F.col("chunk")).otherwise(F.col("last") - F.col("chunk"))
    return joined.select("walk", "step", part.alias("part"), "node", "fwd")
