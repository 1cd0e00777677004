"""Walks and intervals cut into small blocks, held against the same work over whole keys; blocks of matrices."""

import struct

import numpy as np
import pandas as pd
import pytest

from graphloom.operators import coords, graph, intervals, spectral
from graphloom.plans import pipelines
from graphloom.sources import sinks, tables

WALK = "walk string, step long, node long, fwd boolean, len long"


def random_walks():
    rng = np.random.default_rng(3)
    rows = []
    for walk, n in (("long", 200), ("short", 2), ("one", 1), ("gaps", 40)):
        steps = np.cumsum(rng.integers(1, 9, n)) if walk == "gaps" else np.arange(n)
        rows += [(walk, int(s), int(rng.integers(0, 12)), bool(rng.integers(0, 2)), int(rng.integers(0, 5))) for s in steps]
    return rows


def by_walk(rows):
    found = {}
    for r in sorted(rows):
        found.setdefault(r[0], []).append(r)
    return found


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [1, 3, 1 << 16])
def test_walks_in_blocks(spark, size):
    rows = random_walks()
    walks = spark.createDataFrame(rows, WALK)
    places, pairs, short = [], [], []
    for walk, steps in by_walk(rows).items():
        at = 0
        for k, (_, s, node, fwd, n) in enumerate(steps):
            places.append((walk, s, at, at + n))
            at += n
            if k + 1 < len(steps):
                pairs.append((walk, s, node, fwd, steps[k + 1][2], steps[k + 1][3]))
            if k < 30 and at <= 50:
                short.append((walk, s))
    assert rows_of(coords.offsets(walks, size).select("walk", "step", "start", "end")) == sorted(places)
    assert rows_of(graph.step_pairs(walks, size)) == sorted(pairs)
    assert rows_of(coords.capped(walks, 30, 50, size).select("walk", "step")) == sorted(short)
    counts = {}
    for _, _, a, af, b, bf in pairs:
        for pair in ((2 * a + (not af), 2 * b + (not bf)), (2 * b + bf, 2 * a + af)):
            counts[pair] = counts.get(pair, 0) + 1
    assert {(r[0], r[1]): r[2] for r in graph.transitions(walks, size).collect()} == counts


@pytest.mark.parametrize("size", [1, 7, 1 << 24])
def test_seek_and_stretches_in_blocks(spark, size):
    rows = [r for r in random_walks() if r[0] != "gaps"]
    walks = spark.createDataFrame(rows, WALK)
    targets = spark.createDataFrame([(w, t) for w in ("long", "short", "none") for t in range(0, 420, 13)], "walk string, target long")
    whole = rows_of(coords.seek(walks, targets))
    assert rows_of(coords.seek(walks, targets, size=size)) == whole
    starts = {w: [(s, sum(r[4] for r in steps[:k])) for k, (_, s, *_) in enumerate(steps) if s % 10 == 0] for w, steps in by_walk(rows).items()}
    for walk, target, step, start in whole:
        assert (step, start) == max([p for p in starts.get(walk, []) if p[1] <= target], key=lambda p: (p[1], p[0]), default=(None, None))
    near = spark.createDataFrame([(n,) for n in range(12) if n != 5], "node long")
    assert rows_of(coords.between_anchors(walks, 1, 3, near, size)) == rows_of(coords.between_anchors(walks, 1, 3, near))


@pytest.mark.parametrize("size", [1, 10, 1 << 24])
def test_intervals_in_blocks(spark, size):
    rng = np.random.default_rng(5)
    rows = [(k, int(a), int(a + n)) for k in ("a", None) for a, n in zip(rng.integers(-50, 400, 60), rng.integers(0, 15, 60))] + [("long", 0, 390), ("long", 100, 110), ("long", 389, 391)]
    want = []
    for key in ("a", None, "long"):
        held = []
        for s, e in sorted({(s, e) for k, s, e in rows if k == key}):
            if held and s <= held[-1][1]:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([s, e])
        want += [(key, s, e) for s, e in held]
    df = spark.createDataFrame(rows, "key string, start long, end long")
    assert sorted(map(repr, map(tuple, intervals.merged(df, ["key"], size).collect()))) == sorted(map(repr, want))
    runs = spark.createDataFrame([("a", n) for n in (3, 4, 5, 9, 10, 10, 11, 30)] + [("b", 1)], "key string, id long")
    assert rows_of(intervals.id_runs(runs, ["key"], "id", size)) == [("a", 3, 5), ("a", 9, 11), ("a", 30, 30), ("b", 1, 1)]


def test_oriented_reach(spark):
    links = spark.createDataFrame([(0, True, 1, True), (1, True, 2, True), (3, True, 1, True), (2, True, 4, False), (5, True, 0, True), (2, True, 6, True)], "src long, src_fwd boolean, dst long, dst_fwd boolean")
    lens = spark.createDataFrame([(n, 0 if n == 6 else 3) for n in range(7)], "node long, len long")
    start = spark.createDataFrame([(0,)], "node long")
    # 3 lies behind 1 only on the strand that 1 is not entered on; 6 has no length
    assert rows_of(coords.oriented_reach(links, lens, start, 100)) == [(0, 0), (1, 3), (2, 6), (4, 9), (5, 3)]
    assert rows_of(coords.oriented_reach(links, lens, start, 6)) == [(0, 0), (1, 3), (2, 6), (5, 3)]
    assert rows_of(coords.oriented_reach(links, lens, start, 100, stop=1)) == [(0, 0), (1, 3), (5, 3)]


def test_entries_of_a_block(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (150, 2)) if p[0] != p[1]})
    e = spark.createDataFrame([(10 + a, 10 + b) for a, b in pairs], "src long, dst long")
    coo = graph.laplacian(e, multi="drop").toPandas()
    nodes, m = spectral.dense(coo)
    block = spectral.Entries(coo)
    x = rng.standard_normal((len(nodes), 3))
    assert np.allclose(block @ x, m @ x) and np.allclose(block @ x[:, 0], m @ x[:, 0])
    assert block.trace() == np.trace(m) and block.bound() == np.abs(m).sum(axis=1).max()
    exact, near = spectral.smallest(coo, 5), spectral.smallest(coo, 5, full=0)
    assert np.allclose(exact[1], near[1], atol=1e-8) and np.allclose(m @ near[2], near[2] * near[1], atol=1e-6)
    found = pipelines.lowest_eigenpairs(e, 0, 100, 3).toPandas()
    assert len(found) == 3 * len(nodes) and np.allclose(found.groupby("k")["eigenvalue"].first(), exact[1][:3])
    assert [r["k"] for r in pipelines.lowest_eigenvalues(e, 0, 100, 3).orderBy("k").collect()] == [0, 1, 2]
    wide = pd.DataFrame({"row": np.arange(3_200_000), "col": np.arange(3_200_000), "value": 1.0})
    with pytest.raises(spectral.SpectrumError, match="bound"):
        spectral.smallest(wide, 20)


def test_binary_edges_are_split(spark, tmp_path):
    pairs = [(k, 4_000_000_000 - k) for k in range(70_000)]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<II", *p) for p in pairs))
    (tmp_path / "b.bin").write_bytes(struct.pack("<II", 7, 8) + b"\x01\x02")
    (tmp_path / "c.bin").write_bytes(b"")
    read = tables.edge_list(spark, f"{tmp_path}/*.bin")
    assert rows_of(read) == sorted([*pairs, (7, 8)])
    pieces = list(sinks.edge_bytes(read))
    assert b"".join(pieces) == b"".join(struct.pack("<II", *p) for p in sorted([*pairs, (7, 8)])) and len(pieces) < 100
    with pytest.raises(Exception, match="32 bits"):
        list(sinks.edge_bytes(spark.createDataFrame([(1, 1 << 32)], "src long, dst long")))


def test_catalogs_as_frames(spark, tmp_path):
    rows = [{"feature_id": f, "entry": f * 10, "exit": f * 10 + 5, "k": f % 3, "cyclic": f % 7 == 0, "parent_feature": None if f % 4 else f // 4} for f in range(300)]
    alleles = [[[f * 10 + a + n for n in range(a)] for a in range(f % 3)] for f in range(300)]
    features, traversals = sinks.catalog_bytes(rows, alleles)
    records = spark.createDataFrame(rows[::-1], "feature_id long, entry long, exit long, k int, cyclic boolean, parent_feature long")
    lists = spark.createDataFrame([(f, a, nodes) for f, of in enumerate(alleles) for a, nodes in enumerate(of)] + [(900, 0, [1])], "feature_id long, idx long, nodes array<long>")
    a, b = sinks.catalog_pieces(records, lists.repartition(5))
    assert (b"".join(a), b"".join(b)) == (features, traversals)
    (tmp_path / "f").write_bytes(features)
    (tmp_path / "t").write_bytes(traversals)
    back, found = tables.catalog(spark, f"{tmp_path}/f", f"{tmp_path}/t")
    table, all_lists = tables.read_catalog(features, traversals)
    assert [r["nodes"] for r in found.orderBy("i").collect()] == all_lists
    assert [tuple(r)[:6] for r in back.orderBy("feature_id").collect()] == [(r["feature_id"], r["entry"], r["exit"], r["k"], int(r["cyclic"]), r["parent_feature"]) for r in rows]
    assert table["offset"].tolist() == [r["offset"] for r in back.orderBy("feature_id").collect()]
    (tmp_path / "short").write_bytes(b"\x00\x00")
    with pytest.raises(tables.CatalogError):
        tables.catalog(spark, f"{tmp_path}/f", f"{tmp_path}/short")
    with pytest.raises(tables.CatalogError, match="16 bits"):
        sinks.catalog_pieces(records, spark.createDataFrame([(1, 0, [0] * 65_536)], "feature_id long, idx long, nodes array<long>"))


def test_columns_of_any_name_come_through(spark):
    from graphloom.operators import blocks, coords, snarls

    odd = ["block", "each", "inner", "earlier", "bucket", "first", "later", "last", "key0", "key1", "__value", "__block"]
    walks = spark.createDataFrame([("w", k, k % 3, True, 2, *range(len(odd))) for k in range(10)], "walk string, step long, node long, fwd boolean, len long, " + ", ".join(f"{c} long" for c in odd))
    kept = [tuple(range(len(odd)))] * 10
    for df in (
        coords.offsets(walks, 4), blocks.following(walks, ["walk"], "step", "node", size=4),
        blocks.carried(walks, ["walk"], ["step"], walks["node"], "carry", size=4),
        snarls.within_spans(walks, spark.createDataFrame([("w", 0, 9)], "walk string, start long, end long")),
        coords.region_overlaps(walks, spark.createDataFrame([(1, "w", 0, 20)], "region long, walk string, lo long, hi long")),
    ):
        assert [tuple(r) for r in df.select(odd).collect()] == kept
    assert [r["start"] for r in coords.offsets(walks, 4).orderBy("step").collect()] == [2 * k for k in range(10)]
