"""Running totals and neighbours of rows within a key, in blocks of places, so that a long key is many tasks.

A block is a stretch of places (steps or coordinates) of one key. Rows are sorted within (key, block) only. What comes
before a block is a combinable aggregate of one row a block, and a window over those; only blocks with something
before them are joined back, so short keys, which are one block, add nothing.

Keys and places must not be null where ``nulls`` is not set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows or places of one block. At 10^10 steps the table of blocks has 150,000 rows.
STEPS, PLACES = 1 << 16, 1 << 24


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def _joined(rows: DataFrame, side: DataFrame, by: Sequence[str], block: str, before: str, nulls: bool) -> DataFrame:
    """rows with the column before of side(by, block, before), null where side has no such block."""
    keys = fresh(rows, *(f"key{k}" for k in range(len(by) + 1)))
    named = side.where(F.col(before).isNotNull()).select(*by, block, before).toDF(*keys, before)
    on = None
    for name, key in zip([*by, block], keys):
        same = F.col(name).eqNullSafe(F.col(key)) if nulls and name != block else F.col(name) == F.col(key)
        on = same if on is None else on & same
    return rows.join(named, on, "left").drop(*keys)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, how=F.sum, before: bool = False, size: int = STEPS, nulls: bool = False) -> DataFrame:
    """Adds the running sum or maximum of value over (by) in an order whose first column is the place.

    ``before`` leaves the row itself out. Null where there is nothing to sum up.
    """
    block, each, inner, earlier_ = fresh(df.withColumn(name, F.lit(0)), "block", "each", "inner", "earlier")
    rows = df.withColumns({block: F.floor(F.col(order[0]) / size), each: value})
    totals = rows.groupBy(*by, block).agg(how(each).alias(inner))
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    side = totals.select(*by, block, how(inner).over(earlier).alias(earlier_))
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    met = _joined(rows.withColumn(inner, how(each).over(inside)), side, by, block, earlier_, nulls)
    a, b = F.col(inner), F.col(earlier_)
    both = F.greatest(a, b) if how is F.max else F.coalesce(a + b, a, b)
    return met.withColumn(name, both).drop(each, inner, block, earlier_)


def following(df: DataFrame, by: Sequence[str], order: str, *columns: str, name: str = "next", size: int = STEPS) -> DataFrame:
    """Adds a struct of the columns of the next row of (by), null behind the last."""
    block, first, later = fresh(df.withColumn(name, F.lit(0)), "block", "first", "later")
    row = F.struct(*columns)
    rows = df.withColumn(block, F.floor(F.col(order) / size))
    firsts = rows.groupBy(*by, block).agg(F.min_by(row, order).alias(first))
    side = firsts.select(*by, block, F.lead(first).over(Window.partitionBy(*by).orderBy(block)).alias(later))
    met = _joined(rows.withColumn(name, F.lead(row).over(Window.partitionBy(*by, block).orderBy(order))), side, by, block, later, False)
    return met.withColumn(name, F.coalesce(name, later)).drop(block, later)


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, size: int = STEPS) -> DataFrame:
    """Adds the last value that is not null, up to the row itself."""
    block, each, last, earlier_ = fresh(df.withColumn(name, F.lit(0)), "block", "each", "last", "earlier")
    rows = df.withColumns({block: F.floor(F.col(order[0]) / size), each: value})
    # a block without a value of its own needs those before it, so it takes part with a null
    placed = F.when(F.col(each).isNotNull(), F.struct(*order))
    every = rows.groupBy(*by, block).agg(F.max_by(each, placed).alias(last))
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    side = every.select(*by, block, F.last(last, True).over(earlier).alias(earlier_))
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = _joined(rows.withColumn(name, F.last(each, True).over(inside)), side, by, block, earlier_, False)
    return met.withColumn(name, F.coalesce(name, earlier_)).drop(each, block, earlier_)
