"""Drawing as a table of pixels: lines and discs to the pixels they cover, glows as light that adds up.

Each shape comes apart into its pixels on its own, within the canvas only; pixels meet by place. Of lines, and of discs,
the one drawn last counts (a combinable maximum); glows add whole steps of light, so their order does not matter. Lines
lie lowest, glows shine over them, discs lie on top, as layered drawings of graphs have it. Places and orders are whole
numbers, colours from 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import kept

COLOUR = ("r", "g", "b")


def line_pixels(lines: DataFrame, width: int, height: int) -> DataFrame:
    """(order, x, y, r, g, b) of lines(order, x0, y0, x1, y1, r, g, b), both ends included.

    A pixel for each step along the longer axis; the other axis moves where the line passes the middle between two
    pixels, which is the path of the usual integer line algorithm in closed form.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    steps = F.greatest(F.abs(dx), F.abs(dy))
    flat = F.abs(dx) >= F.abs(dy)
    start, sign, size = F.when(flat, F.col("x0")).otherwise(F.col("y0")), F.when(flat, F.sign(dx)).otherwise(F.sign(dy)).cast("bigint"), F.when(flat, width).otherwise(height)
    # steps that lie on the canvas, along the longer axis
    first = F.greatest(F.lit(0), F.when(sign < 0, start - size + 1).otherwise(-start))
    last = F.least(steps, F.when(sign < 0, start).otherwise(size - 1 - start))
    named = lines.select("order", *COLOUR, "x0", "y0", dx.alias("dx"), dy.alias("dy"), steps.alias("n"), first.alias("first"), last.alias("last"))
    along = named.where("first <= last").withColumn("i", F.explode(F.sequence(F.col("first").cast("bigint"), F.col("last").cast("bigint"))))

    def place(begin: str, way: str) -> Column:
        moved = F.expr(f"case when n = 0 then 0 else (2 * i * abs({way}) + n) div (2 * n) end")
        return F.col(begin) + F.sign(F.col(way)).cast("bigint") * moved

    return _inside(along.select("order", place("x0", "dx").alias("x"), place("y0", "dy").alias("y"), *COLOUR), width, height)


def _inside(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def _around(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """shapes(x, y, radius, ...) once for each pixel (px, py) of the canvas within their radius, with dist2."""
    span = lambda c, size: F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("radius")).cast("bigint"), F.least(F.lit(size - 1), F.col(c) + F.col("radius")).cast("bigint"))
    met = shapes.where((F.col("x") + F.col("radius") >= 0) & (F.col("x") - F.col("radius") < width) & (F.col("y") + F.col("radius") >= 0) & (F.col("y") - F.col("radius") < height) & (F.col("radius") >= 0))
    rows = met.withColumn("py", F.explode(span("y", height)))
    cells = rows.withColumn("px", F.explode(span("x", width)))
    far = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    return cells.withColumn("dist2", far).where(F.col("dist2") <= F.col("radius") * F.col("radius"))


def disc_pixels(discs: DataFrame, width: int, height: int) -> DataFrame:
    """(order, x, y, r, g, b) of discs(order, x, y, radius, r, g, b)."""
    return _around(discs, width, height).select("order", F.col("px").alias("x"), F.col("py").alias("y"), *COLOUR)


def glow_pixels(glows: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, r, g, b): light of glows(x, y, radius, r, g, b), full at their middle and down to 0 at their edge with the
    square of the share of the way that is left, in whole steps."""
    left = 1 - F.sqrt("dist2") / F.greatest(F.col("radius"), F.lit(1))
    return _around(glows, width, height).select(F.col("px").alias("x"), F.col("py").alias("y"), *(F.floor(F.col(c) * left * left).alias(c) for c in COLOUR))


#: Places in a drawing up to which the winning orders are sent to all tasks.
FEW = 1 << 20


def last_of(shapes: DataFrame, pixels: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(x, y, c): the colour that was drawn last at each place; of equal orders the brighter one.

    pixels takes shapes(order, ...) apart into (order, x, y, r, g, b). The largest order of a place is one number, summed
    up by hash where the pixels arise; only shapes that are last somewhere come apart again, for their colours.
    """
    last = kept(pixels(shapes).groupBy("x", "y").agg(F.max("order").alias("last")))
    sent = F.broadcast if last.count() <= FEW else lambda side: side
    orders = last.select("last").distinct()
    seen = shapes.join(sent(orders), F.col("order").eqNullSafe(F.col("last")), "left_semi")
    there = last.select(F.col("x").alias("lx"), F.col("y").alias("ly"), "last")
    met = pixels(seen).join(sent(there), (F.col("x") == F.col("lx")) & (F.col("y") == F.col("ly")) & F.col("order").eqNullSafe(F.col("last")))
    return met.groupBy("x", "y").agg(F.max(F.struct(*COLOUR)).alias("c"))


def drawn(lines: DataFrame, glows: DataFrame, discs: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, r, g, b) of every place that some shape covers; all others are black."""
    low = last_of(lines, lambda s: line_pixels(s, width, height)).withColumnRenamed("c", "low")
    light = glow_pixels(glows, width, height).groupBy("x", "y").agg(*(F.sum(c).alias(f"light_{c}") for c in COLOUR))
    top = last_of(discs, lambda s: disc_pixels(s, width, height)).withColumnRenamed("c", "top")
    met = low.join(light, ["x", "y"], "full").join(top, ["x", "y"], "full")

    def blended(c: str) -> Column:
        under = F.coalesce(F.col(f"low.{c}"), F.lit(0)) + F.coalesce(F.col(f"light_{c}"), F.lit(0))
        return F.when(F.col("top").isNotNull(), F.col(f"top.{c}")).otherwise(F.least(under, F.lit(255))).cast("bigint").alias(c)

    return met.select("x", "y", *(blended(c) for c in COLOUR))
