"""Laid-out graph tables with their rules, and the stored index of places."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coords
from graphloom.operators.position_index import PositionIndex, write
from graphloom.plans import pipelines
from graphloom.sources import bundles

GFA = "\n".join(["S\t1\tAAAAA", "S\t2\tCC", "S\t3\tGGG", "S\t4\t*", "L\t1\t+\t2\t+\t0M", "L\t2\t+\t3\t-\t0M", "W\ts\t1\tc\t0\t10\t>1>2<3", "P\tr#0#c\t1+,3-,4+\t*"]) + "\n"
PARTS = {
    "nodes": ("name string, seq string, len long, node long", [("1", "AAAAA", 5, 0), ("2", "CC", 2, 1), ("3", None, 3, 2)]),
    "links": ("src long, src_fwd boolean, dst long, dst_fwd boolean", [(0, True, 1, True), (1, True, 2, False)]),
    "walks": ("walk string, step long, node long, fwd boolean, len long", [("a", 0, 0, True, 5), ("a", 1, 1, True, 2), ("b", 0, 2, False, 3)]),
    "paths": ("walk string, sample string, phase int, contig string, fragment long", [("a", "a", 0, "c", None), ("b", "b", 0, "c", None)]),
}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_round_trip_and_reuse(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA)
    out = f"{tmp_path}/bundle"
    assert not bundles.exists(spark, out)
    with pytest.raises(bundles.BundleError):
        bundles.read(spark, out)
    first = pipelines.resolve(spark, f"{tmp_path}/g.gfa", out)
    (tmp_path / "g.gfa").unlink()  # the tables are used again, not the text
    again = pipelines.resolve(spark, f"{tmp_path}/g.gfa", out)
    want = pipelines.coord2node(first, "c:1-7").select("walk", "node").collect()
    assert len(want) == 4 and sorted(want) == sorted(pipelines.coord2node(again, "c:1-7").select("walk", "node").collect())
    assert sorted(again["walks"].collect()) == sorted(again["visits"].select(*again["walks"].columns).collect())


def test_joins_by_node_and_by_walk_need_no_exchange(spark, tmp_path):
    bundles.write({k: spark.createDataFrame(rows, schema) for k, (schema, rows) in PARTS.items()}, f"{tmp_path}/b", 4)
    parts = bundles.read(spark, f"{tmp_path}/b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_node = parts["visits"].join(parts["nodes"].select("node", "seq"), "node").groupBy("node").count()
        by_walk = parts["walks"].join(parts["paths"], "walk").groupBy("walk").agg(F.sum("len"))
        by_source = parts["links"].join(parts["nodes"].withColumnRenamed("node", "src"), "src")
        assert [exchanges(x) for x in (by_node, by_walk, by_source)] == [0, 0, 0]
        assert {r[0]: r[1] for r in by_walk.collect()} == {"a": 7, "b": 3} and by_node.count() == 3 and by_source.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


BREAKS = {
    "nodes are numbered from 0 without a gap": ("nodes", lambda r: [*r, ("9", None, 1, 9)]),
    "a node is there once": ("nodes", lambda r: [*r, ("2", "CC", 2, 1)]),
    "a node is as long as its sequence": ("nodes", lambda r: [("1", "AAAA", 5, 0), *r[1:]]),
    "a link starts at a node": ("links", lambda r: [*r, (7, True, 1, True)]),
    "a link ends at a node": ("links", lambda r: [*r, (1, True, 7, True)]),
    "steps are numbered from 0 without a gap": ("walks", lambda r: [*r, ("a", 3, 0, True, 5)]),
    "a step is on a node": ("walks", lambda r: [*r, ("b", 1, 5, True, 1)]),
    "a step is as long as its node": ("walks", lambda r: [*r, ("b", 1, 1, True, 1)]),
    "a walk has one name, and a name a walk": ("paths", lambda r: [*r, ("z", "z", 0, "c", None)]),
}


@pytest.mark.parametrize("rule", [None, *BREAKS])
def test_rules(spark, rule):
    parts = {k: spark.createDataFrame(BREAKS[rule][1](rows) if rule and BREAKS[rule][0] == k else rows, schema) for k, (schema, rows) in PARTS.items()}
    found = {r["rule"]: r["broken"] for r in bundles.broken_rules({**parts, "visits": parts["walks"]}).collect()}
    assert set(found) == set(BREAKS)
    broken = {r for r, n in found.items() if n}
    also = {"nodes are numbered from 0 without a gap"} if rule == "a node is there once" else set()
    assert broken == ({rule} if rule else set()) | also


def test_a_broken_bundle_is_refused(spark, tmp_path):
    parts = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in PARTS.items()}
    bundles.write({**parts, "walks": parts["walks"].where("not (walk = 'a' and step = 0)")}, f"{tmp_path}/b", 2)
    with pytest.raises(bundles.BundleError, match="without a gap: 1"):
        bundles.read(spark, f"{tmp_path}/b")
    assert bundles.read(spark, f"{tmp_path}/b", check=False)["walks"].count() == 2


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"w{w}", k, (w * 7 + k) % 30, k % 3 > 0, 1 + (w + k) % 6) for w in range(6) for k in range(200)]
    walks = spark.createDataFrame(rows, "walk string, step long, node long, fwd boolean, len long")
    path = f"{tmp_path_factory.mktemp('index')}/i"
    write(walks, path, every=10, file_steps=100)
    return walks, PositionIndex(spark, path), path


def test_only_the_files_named_are_opened(spark, index):
    walks, stored, path = index
    files = spark.read.parquet(f"{path}/steps").inputFiles()
    assert len(files) > 8
    targets = spark.createDataFrame([("w3", 5), ("w3", 6), ("w0", 0)], "walk string, target long")
    found = stored.at(targets)
    assert 1 <= len(found.inputFiles()) - len(spark.createDataFrame([(1,)], "a int").inputFiles()) <= 2
    want = coords.offsets(walks).join(targets, "walk").where("start <= target and end > target").select("walk", "target", "step", "node", "fwd", (F.col("target") - F.col("start")).alias("offset"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lookups_are_those_without_an_index(spark, index):
    walks, stored, _ = index
    regions = spark.createDataFrame([(k, f"w{k % 7}", k * 13, k * 13 + 1 + k % 40) for k in range(60)], "region long, walk string, lo long, hi long")
    columns = ["region", "walk", "step", "off_start", "off_end"]
    assert sorted(map(tuple, stored.overlaps(regions).select(columns).collect())) == sorted(map(tuple, coords.region_overlaps(walks, regions).select(columns).collect()))
    targets = regions.select("walk", F.col("lo").alias("target")).distinct()
    assert sorted(map(repr, stored.seek(targets).collect())) == sorted(map(repr, coords.seek(walks, targets).collect()))


def test_nothing_asked(spark, index):
    assert index[1].at(spark.createDataFrame([], "walk string, target long")).count() == 0
    assert index[1].at(spark.createDataFrame([("none", 1)], "walk string, target long")).count() == 0
