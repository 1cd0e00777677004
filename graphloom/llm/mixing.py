"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. The whole part is taken
as it is; the fraction is rounded by the pivotal method: two documents meet, word mass moves at random from one to the
other until one fraction is 0 or 1, and the other goes on to the next. The direction is drawn so that every document
keeps its expected copies, and since mass is counted in words, a source's taken words stay at its target but for the
single document that is left at the end. Documents meet from the largest down, an outlier with several at once, so
that the one left is among the small ones. They meet first in salted buckets of bounded size, so a source with a third of all rows is many tasks;
each bucket hands on one residual, and residuals meet in a reduction tree of fixed fan-in until each source has one,
which goes to the nearer of 0 and 1. That last step alone does not keep an expectation.

Draws hash what a document is (id, text and, of rows that repeat both, a running number), the level and a seed, and
never where it lies: reruns agree, however the table is divided.

Cases: a null or blank text has size 0 and takes 0 words; a very long text is one document, taken whole; a null source
is a source of its own, last; if no text has a word all targets are 0; ties of size are met in the order of id and
text; rows whose id is null or repeated count each as a row of its own, in buckets of their own; an empty table gives
no rows; other columns are ignored. ``mix`` repeats a row as often as it is taken and leaves other columns alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, numbered, table

#: Documents that meet in one first-level bucket on average.
BUCKET = 1024
#: Buckets of one level whose residuals meet in one bucket of the next.
FAN_IN = 256
#: A document of more than so many times the next one's size meets several at once.
LARGE = 2
#: Word mass that is taken for none.
NONE = 1e-9


def ranked_sources(rows: DataFrame) -> DataFrame:
    """(source, n, source_size, rank): rank from 0 by code point, null last, without a single-partition window.

    Sources are range-partitioned; only one row count per partition comes to the driver.
    """
    spark = rows.sparkSession
    sums = cut(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    local = cut(sums.repartitionByRange(parts, order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    start, offsets = 0, [(-1, 0)]
    for part, n in sorted((r["part"], r["count"]) for r in local.groupBy("part").count().collect()):
        offsets.append((part, start))
        start += n
    before = spark.createDataFrame(offsets, "part int, before long")
    return local.join(F.broadcast(before), "part").select("source", "n", "source_size", (F.col("at") + F.col("before")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target: the total shared by weight, none above most times its size, the excess reshared by weight.

    A round caps every source that the present share would lift above its bound. Shares only grow from round to
    round, so a capped source stays capped, and the rounds end with no source above.
    """
    spec = F.array(*[F.lit(float(w)) for w in weights])
    now = cut(sources.select("*", F.element_at(spec, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"), F.lit(False).alias("full")))
    total = now.agg(F.sum("source_size")).first()[0] or 0
    bound = F.col("source_size") * most
    while True:
        free = now.agg(F.sum(F.when(~F.col("full"), F.col("weight"))), F.sum(F.when(F.col("full"), bound))).first()
        share = (total - (free[1] or 0.0)) / free[0] if free[0] else 0.0
        above = ~F.col("full") & (F.col("weight") * share > bound)
        if not free[0] or now.where(above).isEmpty():
            return now.withColumn("target", F.when(F.col("full"), bound).otherwise(F.col("weight") * F.lit(share)))
        now = cut(now.withColumn("full", F.col("full") | above))


def _uniform(*key: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2**64


def pivot(names: list, size: np.ndarray, mass: np.ndarray, salt: str) -> tuple[dict[int, int], int | None]:
    """Settles documents in the order given, from the largest down; mass is changed in place. Returns 0/1 by position,
    and the one left.

    Two documents meet: the first gains what the second can give and it can hold, or loses what it has and the second
    can hold, with probabilities that change neither's expectation. Either way one of the two becomes 0 or 1.

    A first document of more than LARGE times the second's size would outlast hundreds of such meetings and be left at
    the end. Its partner is the shortest run of next documents that have room for it instead, each exchanging with it
    in proportion to its room r_j, the lesser of what it has and can still hold. With mass m of size s, the first rises
    to s with probability m / s, and r_j / R of s - m comes from each; else it falls to 0, and r_j / R of m goes to
    each. Both are within r_j where R >= max(m, s - m). The first's expected change is m/s (s - m) - (1 - m/s) m = 0,
    that of the others -r_j/R times the same, so no expectation changes here either, nor does the sum.
    """
    settled: dict[int, int] = {}
    now = None
    for i in range(len(names)):
        if mass[i] <= NONE or mass[i] >= size[i] - NONE:  # an exchange has used up all its room
            settled[i] = int(mass[i] > NONE)
            continue
        if now is None:
            now = i
            continue
        if size[now] > LARGE * size[i]:
            room = np.cumsum(np.minimum(mass[i:], size[i:] - mass[i:]))
            need = max(mass[now], size[now] - mass[now])
            if room[-1] >= need:
                run = slice(i, i + int(np.searchsorted(room, need)) + 1)
                share = np.minimum(mass[run], size[run] - mass[run])
                share /= share.sum()
                settled[now] = int(_uniform(salt, names[now]) * size[now] < mass[now])
                mass[run] += share * (mass[now] - size[now] * settled[now])
                mass[now] = size[now] * settled[now]
                now = i if NONE < mass[i] < size[i] - NONE else None
                if now is None:
                    settled[i] = int(mass[i] > NONE)
                continue
        up, down = min(size[now] - mass[now], mass[i]), min(mass[now], size[i] - mass[i])  # what the first may gain and lose
        if _uniform(salt, names[now], names[i]) * (up + down) < down:
            won, lost, full, empty = now, i, size[now] - mass[now] <= mass[i], mass[i] <= size[now] - mass[now]
            mass[now], mass[i] = mass[now] + up, mass[i] - up
        else:
            won, lost, full, empty = i, now, size[i] - mass[i] <= mass[now], mass[now] <= size[i] - mass[i]
            mass[now], mass[i] = mass[now] - down, mass[i] + down
        settled |= ({won: 1} if full else {}) | ({lost: 0} if empty else {})
        now = None if full and empty else now if i in settled else i
    return settled, now


SETTLED = "row long, name string, size long, source string, bucket long, mass double, extra long"


def _meeting(salt: str, root: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What one bucket does: extra is 0 or 1 for the settled, null for the residual, which the root settles too."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "name"], ascending=[False, True])
        mass = pdf["mass"].to_numpy().copy()
        settled, left = pivot(pdf["name"].tolist(), pdf["size"].to_numpy(np.float64), mass, salt)
        if left is not None and root:
            settled[left] = int(2 * mass[left] >= pdf["size"].iloc[left])
        extra = [settled.get(i) for i in range(len(pdf))]
        return pdf.assign(mass=mass, extra=pd.array(extra, dtype="Int64"))[["row", "name", "size", "source", "bucket", "mass", "extra"]]

    return meet


def _named(rows: DataFrame) -> DataFrame:
    """Adds name: id and hash of the text, and a number that tells rows apart that repeat both.

    Numbers run through each partition of the scan and go on from partition to partition, so that rows which repeat
    one id and text, were they a third of all, are never gathered in one task.
    """
    key, part = ["source", "id", "size", "mark"], F.shiftright("row", 33).alias("part")
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key, part).agg(F.count("*").alias("n"), F.min("row").alias("row"))
    base = counts.select("part", *key, "row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1
    # the first row of a partition carries the number its partition goes on from
    first = base.where("base > 0").select("row", "base")
    carried = rows.join(first, "row", "left").withColumn("part", F.shiftright("row", 33))
    number = at + F.max(F.coalesce("base", F.lit(0))).over(Window.partitionBy(*key, "part"))
    return carried.select(*rows.columns, F.concat_ws("/", "id", F.hex("mark"), number.cast("string")).alias("name"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, size, source_size, target, copies."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = cut(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), mark.alias("mark")))
    wanted = targets(ranked_sources(rows), weights, most)
    goal = cut(wanted.select(F.col("source").alias("of"), "n", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")))
    largest = goal.agg(F.max("n")).first()[0] or 0
    mass = F.col("size") * (F.col("rate") - F.floor("rate"))
    bucket = F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / BUCKET))
    plan = cut(_named(rows).join(goal, F.col("source").eqNullSafe(F.col("of"))).select("row", "id", "name", "size", "source", "source_size", "target", F.floor("rate").alias("whole"), mass.alias("mass"), bucket.alias("bucket")))
    open_ = plan.where("mass > 0 and mass < size").select("row", "name", "size", "source", "bucket", "mass")
    extra, buckets, level = None, math.ceil(largest / BUCKET), 0
    while True:
        met = cut(open_.groupBy("source", "bucket").applyInPandas(_meeting(f"{seed}/{level}", buckets <= 1), SETTLED))
        settled = met.where("extra is not null").select("row", "extra")
        extra = extra.unionByName(settled) if extra else settled
        if buckets <= 1:
            break
        open_ = met.where("extra is null").select("row", "name", "size", "source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "mass")
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
    return plan.join(extra, "row", "left").select("row", "id", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    rows, row = numbered(docs)
    n = fresh(rows, "copies")
    taken = cut(copies(rows, row_col=row, **options).where("copies > 0").select(F.col("row").alias(row), F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(n)))
    return rows.join(taken, row).drop(row).withColumn(n, F.explode(n)).drop(n)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
