"""Layout by forces, against sums over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import layout as L


def frame(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node long, x double, y double")


def pushed(xy, strength):
    d = xy[:, None] - xy[None]
    return strength * (d / ((d**2).sum(-1, keepdims=True) + L.SOFT)).sum(1)


def pulled(xy, edges, ideal):
    out = np.zeros_like(xy)
    for a, b in edges:
        d = xy[b] - xy[a]
        f = d * np.sqrt(d @ d + L.SOFT) / ideal
        out[a] += f
        out[b] -= f
    return out


def steps(xy, edges, iterations):
    ideal = (1 / len(xy)) ** 0.5
    for k in range(iterations):
        f = pushed(xy, ideal**2) + pulled(xy, edges, ideal)
        size = np.sqrt((f**2).sum(1) + L.SOFT)
        xy = xy + f * (np.minimum(size, L.HEAT * (1 - k / iterations)) / size)[:, None]
    return xy


def values(df, *columns):
    return np.array([[r[c] for c in columns] for r in sorted(df.collect(), key=lambda r: r["node"])])


def crowds(n):
    """Half spread out, a third within a thousandth, the rest copies of one place."""
    rng = np.random.default_rng(3)
    xy = rng.random((n, 2))
    xy[n // 2 : n - n // 6] = 0.3 + rng.random((n - n // 6 - n // 2, 2)) / 1000
    xy[n - n // 6 :] = (0.9, 0.1)
    return xy


@pytest.mark.parametrize("n", [1, 20, 500])
def test_small_cells_are_exact(spark, n):
    """With cells large enough to hold all nodes, and with cells divided but all of them near, no sum is replaced."""
    xy = np.random.default_rng(n).random((n, 2))
    want = pushed(xy, 0.5)
    assert np.allclose(values(L.repulsion(frame(spark, xy), 0.5, most=n), "fx", "fy"), want, atol=1e-9)
    assert np.allclose(values(L.repulsion(frame(spark, xy), 0.5, most=max(n // 4, 1), reach=8), "fx", "fy"), want, atol=1e-9)


def test_far_cells_as_masses(spark):
    """Forces come near those of all pairs where crowds and copies lie beside scattered nodes."""
    xy = crowds(600)
    want = pushed(xy, 1.0)
    got = values(L.repulsion(frame(spark, xy), 1.0, most=8), "fx", "fy")
    off = np.linalg.norm(got - want, axis=1) / np.linalg.norm(want, axis=1)
    assert np.quantile(off, 0.95) < 0.02 and off.max() < 0.2
    plan = L.repulsion(frame(spark, xy), 1.0, most=8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_steps(spark):
    rng = np.random.default_rng(5)
    xy = rng.random((60, 2))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2))] + [(3, 4), (4, 3), (3, 4)]
    ends = spark.createDataFrame([*edges, (7, 7), (8, 999)], "src long, dst long")
    got = values(L.laid_out(frame(spark, xy), ends, iterations=4, most=60), "x", "y")
    assert np.allclose(got, steps(xy, edges, 4), atol=1e-7)


def test_edge_cases(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert L.laid_out(frame(spark, []), none).count() == 0
    assert values(L.laid_out(frame(spark, [(0.5, 0.5)]), none), "x", "y").tolist() == [[0.5, 0.5]]
    same = values(L.laid_out(frame(spark, [(0.5, 0.5)] * 50), none, iterations=2, most=8), "x", "y")
    assert np.allclose(same, 0.5)
    placed = L.scattered(spark.range(100).select(F.col("id").alias("node")))
    assert placed.where("x between 0 and 1 and y between 0 and 1").select("x", "y").distinct().count() == 100


def test_no_more_levels_than_cells_need(spark, monkeypatch):
    """Scattered nodes are not counted in cells of all levels; crowds still are, with the same forces."""
    asked, of = [], L._in_cells
    monkeypatch.setattr(L, "_in_cells", lambda nodes, depth: asked.append(depth) or of(nodes, depth))
    L.repulsion(frame(spark, np.random.default_rng(2).random((300, 2))), 1.0, most=8)
    assert max(asked) < L.DEPTH
    asked.clear()
    L.repulsion(frame(spark, crowds(300)), 1.0, most=8)
    assert max(asked) == L.DEPTH


def test_a_crowd_in_several_tiles(spark):
    """Tiles of few nodes, on levels that differ, and copies of one place dealt to several of them."""
    xy = crowds(900)
    slabs = L._in_slabs(*(lambda df: (df, 900, 900))(frame(spark, xy).withColumnRenamed("node", "at")))
    tiles = L._tiles(L._around(slabs), 8, L.DEPTH)
    assert tiles.shares.max() > 1 and len(set(tiles.level.tolist())) > 2 and tiles.level.max() == L.DEPTH
    want = pushed(xy, 1.0)
    got = values(L.repulsion(frame(spark, xy), 1.0, most=8), "fx", "fy")
    off = np.linalg.norm(got - want, axis=1) / np.linalg.norm(want, axis=1)
    assert np.quantile(off, 0.95) < 0.02 and off.max() < 0.2


def test_names_and_gaps(spark):
    """Places are those of 0, 1, 2 where nodes have names, or numbers with gaps; nodes without a name or a place are left out."""
    rng = np.random.default_rng(6)
    xy, edges = rng.random((40, 2)), rng.integers(0, 40, (70, 2)).tolist()
    want = steps(xy, edges, 2)
    for named, kind in ((lambda k: 5 + 2 * k, "int"), (lambda k: k * 10**12, "long"), (lambda k: f"n{k:02}", "string")):
        nodes = spark.createDataFrame([*((named(k), float(x), float(y)) for k, (x, y) in enumerate(xy)), (None, 0.5, 0.5), (named(50), None, 0.5), (named(51), 0.5, float("nan"))], f"node {kind}, x double, y double")
        ends = spark.createDataFrame([*((named(a), named(b)) for a, b in edges), (named(1), named(99)), (named(2), named(50)), (None, named(1))], f"src {kind}, dst {kind}")
        found = L.laid_out(nodes, ends, iterations=2)
        assert dict(found.dtypes)["node"] == {"int": "int", "long": "bigint", "string": "string"}[kind]
        assert np.allclose(values(found, "x", "y"), want, atol=1e-7)


def test_blocks_of_edges(spark, monkeypatch):
    """Edges of one pair of ends count wherever they lie, and blocks are cut where they are full."""
    monkeypatch.setattr(L, "BLOCK", 16)
    rng = np.random.default_rng(9)
    xy, edges = rng.random((50, 2)), [*rng.integers(0, 50, (300, 2)).tolist(), *[(4, 9)] * 90]
    assert np.allclose(values(L.laid_out(frame(spark, xy), spark.createDataFrame(edges, "src long, dst long"), iterations=2), "x", "y"), steps(xy, edges, 2), atol=1e-7)


def test_a_step_exchanges_little(spark):
    """No lists of what acts on a cell are exchanged, and no node once for each level."""
    sc = spark.sparkContext
    nothing = sc._gateway.new_array(sc._jvm.double, 0)

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    xy, n = np.random.default_rng(4).random((4000, 2)), 4000
    edges = spark.createDataFrame(np.random.default_rng(5).integers(0, n, (8000, 2)).tolist(), "src long, dst long")
    before = moved()
    L.laid_out(frame(spark, xy), edges, iterations=2).count()
    assert moved() - before < 1000 * n
