"""Pixels of shapes, against drawing one after another into an array."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import raster
from graphloom.sources import sinks

LINES, GLOWS, DISCS = "order long, x0 long, y0 long, x1 long, y1 long, r long, g long, b long", "x long, y long, radius long, r long, g long, b long", "order long, x long, y long, radius long, r long, g long, b long"


def walked(x0, y0, x1, y1):
    """The integer line, one pixel after another, by its running error."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    error, out = dx + dy, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + sx
        if twice <= dx:
            error, y0 = error + dx, y0 + sy


def test_lines_in_all_directions(spark):
    ends = [(12, 9, 12 + a, 9 + b) for a in range(-7, 8) for b in range(-7, 8)]
    lines = spark.createDataFrame([(k, *e, 1, 2, 3) for k, e in enumerate(ends)], LINES)
    got = {}
    for r in raster.line_pixels(lines, 30, 30).collect():
        got.setdefault(r["order"], set()).add((r["x"], r["y"]))
    assert got == {k: set(walked(*e)) for k, e in enumerate(ends)}


def test_lines_are_cut_at_the_canvas(spark):
    ends = [(-5, 3, 40, 3), (3, 50, 3, -50), (-10**9, 5, 10**9, 5), (-9, -9, -1, -1), (35, -5, -5, 35), (2, 2, 2, 2)]
    lines = spark.createDataFrame([(k, *e, 1, 2, 3) for k, e in enumerate(ends)], LINES)
    got = {}
    for r in raster.line_pixels(lines, 20, 10).collect():
        got.setdefault(r["order"], set()).add((r["x"], r["y"]))
    want = {k: {(x, y) for x, y in walked(*e) if 0 <= x < 20 and 0 <= y < 10} for k, e in enumerate(ends) if k != 2}
    want[2] = {(x, 5) for x in range(20)}
    assert got == {k: v for k, v in want.items() if v}


def painted(lines, glows, discs, w, h):
    image = np.zeros((h, w, 3), int)
    for _, *e, r, g, b in sorted(lines):
        for x, y in walked(*e):
            if 0 <= x < w and 0 <= y < h:
                image[y, x] = r, g, b
    for cx, cy, rad, *c in glows:
        for y in range(max(0, cy - rad), min(h, cy + rad + 1)):
            for x in range(max(0, cx - rad), min(w, cx + rad + 1)):
                d = (x - cx) ** 2 + (y - cy) ** 2
                if d <= rad * rad:
                    a = 1 - math.sqrt(d) / rad
                    image[y, x] = [min(255, old + math.floor(v * a * a)) for old, v in zip(image[y, x], c)]
    for _, cx, cy, rad, *c in sorted(discs):
        for y in range(h):
            for x in range(w):
                if (x - cx) ** 2 + (y - cy) ** 2 <= rad * rad:
                    image[y, x] = c
    return image


@pytest.fixture(scope="module")
def scene():
    rng = random.Random(4)
    w, h = 40, 25
    at = lambda: (rng.randrange(-8, w + 8), rng.randrange(-8, h + 8))
    colour = lambda: tuple(rng.randrange(256) for _ in range(3))
    lines = [(k, *at(), *at(), *colour()) for k in range(30)]
    return lines, [(*at(), rng.randrange(1, 9), *colour()) for _ in range(25)], [(k, *at(), rng.randrange(4), *colour()) for k in range(12)], w, h


def test_layers(spark, scene):
    lines, glows, discs, w, h = scene
    pixels = raster.drawn(spark.createDataFrame(lines, LINES), spark.createDataFrame(glows, GLOWS), spark.createDataFrame(discs, DISCS), w, h)
    got = np.zeros((h, w, 3), int)
    for r in pixels.collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert (got == painted(*scene)).all() and pixels.count() == pixels.select("x", "y").distinct().count()


def test_image(spark, scene):
    lines, glows, discs, w, h = scene
    pixels = raster.drawn(spark.createDataFrame(lines, LINES), spark.createDataFrame(glows, GLOWS), spark.createDataFrame(discs, DISCS), w, h)
    data = b"".join(sinks.image_bytes(pixels, w, h))
    assert len(data) == 18 + 3 * w * h and data[2] == 2 and data[12] == w and data[14] == h and data[16] == 24
    assert (np.frombuffer(data[18:], np.uint8).reshape(h, w, 3)[:, :, ::-1] == painted(*scene)).all()


def test_nothing(spark):
    empty = raster.drawn(spark.createDataFrame([], LINES), spark.createDataFrame([], GLOWS), spark.createDataFrame([], DISCS), 4, 3)
    assert empty.count() == 0 and b"".join(sinks.image_bytes(empty, 4, 3))[18:] == bytes(36)


def test_last_of_sums_up_by_hash(spark):
    """The pixels of all shapes are summed up where they arise and never sorted; of equal orders the brighter one counts."""
    lines = spark.createDataFrame([(1, 0, 0, 9, 0, 5, 5, 5), (2, 0, 0, 4, 0, 1, 2, 3), (2, 2, 0, 6, 0, 1, 3, 0), (None, 0, 1, 3, 1, 7, 7, 7)], LINES)
    plan = []

    def pixels(shapes):
        out = raster.line_pixels(shapes, 10, 5)
        plan.append(out.groupBy("x", "y").agg(F.max("order"))._jdf.queryExecution().executedPlan().toString())
        return out

    got = {(r["x"], r["y"]): tuple(r["c"]) for r in raster.last_of(lines, pixels).collect()}
    want = {(x, 0): (1, 2, 3) if x < 2 else (1, 3, 0) if x < 7 else (5, 5, 5) for x in range(10)}
    assert got == {**want, **{(x, 1): (7, 7, 7) for x in range(4)}}
    assert len(plan) == 2 and "SortAggregate" not in plan[0]
