"""Graph text files (GFA) as DataFrames: one scan, records told apart by their first field.

A file is read by ``spark.read.text``: splits never cut a line, ``.gz`` is read (as one split), and any file system of
Hadoop works (local paths, ``s3a://``, ``hdfs://``). No schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ascii_trim


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields) of every line that is neither blank nor a comment."""
    text = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    return text.select(F.get(fields, 0).alias("kind"), fields.alias("fields"))


def _field(k: int) -> Column:
    return ascii_trim(F.get("fields", F.lit(k)))


def _tag(name: str) -> Column:
    tags = F.filter("fields", lambda t: F.startswith(t, F.lit(name)))
    return F.substring_index(F.get(tags, 0), ":", -1)


def headers(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'H'").select(F.explode(F.slice("fields", 2, F.greatest(F.size("fields") - 1, F.lit(0)))).alias("tag"))


def segments(rows: DataFrame) -> DataFrame:
    """(name, seq, sn, so, sr); a sequence of ``*`` is null, empty names are dropped."""
    found = rows.where("kind = 'S'").select(_field(1).alias("name"), F.when(_field(2) != "*", _field(2)).alias("seq"), _tag("SN:Z:").alias("sn"), _tag("SO:i:").try_cast("bigint").alias("so"), _tag("SR:i:").try_cast("int").alias("sr"))
    return found.where("name is not null and name <> ''")


def links(rows: DataFrame) -> DataFrame:
    """(src, src_fwd, dst, dst_fwd) of L lines with six fields or more; overlaps are ignored."""
    full = rows.where((F.col("kind") == "L") & (F.size("fields") >= 6))
    return full.select(_field(1).alias("src"), (_field(2) != "-").alias("src_fwd"), _field(3).alias("dst"), (_field(4) != "-").alias("dst_fwd"))


def path_steps(rows: DataFrame) -> DataFrame:
    """(walk, step, name, fwd) of P lines: ``11+,12-``; the last character is the orientation, ``-`` is reverse."""
    steps = rows.where("kind = 'P'").select(_field(1).alias("walk"), F.posexplode(F.split(_field(2), ",")).alias("step", "s")).where("length(s) > 1")
    return steps.select("walk", F.col("step").cast("bigint").alias("step"), F.expr("left(s, length(s) - 1)").alias("name"), (F.right("s", F.lit(1)) != "-").alias("fwd"))


def walk_steps(rows: DataFrame) -> DataFrame:
    """(walk, start, stop, step, name, fwd) of W lines as the public format has them: ``>11<12`` behind six fields.

    Each line is a walk of its own: ``sample#haplotype#contig``, and ``[start]`` behind it where a fragment starts
    beyond 0, so that fragments of one contig stay apart.
    """
    start = _field(4).try_cast("bigint")
    named = F.concat(F.concat_ws("#", _field(1), _field(2), _field(3)), F.when(start > 0, F.concat(F.lit("["), start.cast("string"), F.lit("]"))).otherwise(F.lit("")))
    found = rows.where("kind = 'W'").select(named.alias("walk"), start.alias("start"), _field(5).try_cast("bigint").alias("stop"), F.posexplode(F.regexp_extract_all(_field(6), F.lit("[><][^><]+"), F.lit(0))).alias("step", "s"))
    return found.select("walk", "start", "stop", F.col("step").cast("bigint").alias("step"), F.expr("substring(s, 2)").alias("name"), F.startswith("s", F.lit(">")).alias("fwd"))


def path_names(walks: DataFrame) -> DataFrame:
    """(walk, sample, phase, contig, fragment) from ``sample#phase#contig[fragment]``."""
    from ..functions.scalars import let

    def parts(p: Column) -> Column:
        contig = F.when(F.size(p) > 2, F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(1))), "#")).otherwise(F.get(p, F.size(p) - 1))
        return F.struct(F.get(p, 0).alias("sample"), F.when(F.size(p) > 2, F.get(p, 1).try_cast("int")).alias("phase"), F.substring_index(contig, "[", 1).alias("contig"))

    fragment = F.regexp_extract("walk", r"\[([0-9]+)", 1)
    split = walks.select("walk", let(F.split("walk", "#", -1), parts).alias("p"), F.when(fragment != "", fragment.try_cast("bigint")).alias("fragment"))
    return split.select("walk", "p.sample", "p.phase", "p.contig", "fragment")


def sequences_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(name, seq) of the segments asked for by wanted(name); the scan keeps only those."""
    return segments(lines(spark, path)).where("seq is not null").select("name", "seq").join(wanted.select("name"), "name", "left_semi")
