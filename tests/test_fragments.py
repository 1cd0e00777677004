"""Fragments of one contig are walks of their own and lie where they start."""

import pytest

from graphloom.plans import pipelines
from graphloom.sources import gfa

LINES = [
    "H\tVN:Z:1.1", "S\t1\tAAAAA", "S\t2\tCCCCC", "S\t3\tGGGGG", "S\t4\tTTTTT", "S\t4\t*",
    "L\t1\t+\t2\t+\t0M", "L\t2\t+\t3\t+\t0M", "L\t3\t+\t4\t+\t0M",
    "W\tGRCh38\t0\tchr1\t0\t10\t>1>2", "W\tGRCh38\t0\tchr1\t1000\t1015\t>2>3>4", "W\tHG1\t1\tchr1\t*\t*\t>1>2>3>4",
    "P\tGRCh38#0#chr2[500]\t3+,4-\t*",
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g.gfa"
    path.write_text("\n".join(LINES) + "\n")
    return pipelines.bundle(spark, str(path))


def test_two_lines_of_a_contig_are_two_walks(parts):
    walks = {}
    for r in parts["walks"].orderBy("walk", "step").collect():
        walks.setdefault(r["walk"], []).append((r["step"], r["node"], r["fwd"]))
    assert walks["GRCh38#0#chr1"] == [(0, 0, True), (1, 1, True)]
    assert walks["GRCh38#0#chr1[1000]"] == [(0, 1, True), (1, 2, True), (2, 3, True)]
    assert walks["HG1#1#chr1"] == [(k, k, True) for k in range(4)]
    assert walks["GRCh38#0#chr2[500]"] == [(0, 2, True), (1, 3, False)]
    names = {r["walk"]: (r["sample"], r["phase"], r["contig"], r["fragment"]) for r in parts["paths"].collect()}
    assert names["GRCh38#0#chr1[1000]"] == ("GRCh38", 0, "chr1", 1000) and names["GRCh38#0#chr1"] == ("GRCh38", 0, "chr1", None)


@pytest.mark.parametrize(
    ("region", "want"),
    [
        ("chr1:1001-1005", [("GRCh38#0#chr1[1000]", 1, 1000, 1005, 0, 5)]),
        ("chr1:1004-1007", [("GRCh38#0#chr1[1000]", 1, 1000, 1005, 3, 5), ("GRCh38#0#chr1[1000]", 2, 1005, 1010, 0, 2)]),
        ("chr1:1-5", [("GRCh38#0#chr1", 0, 0, 5, 0, 5)]),
        ("chr1:11-1000", []),
        ("chr1:1016-1020", []),
        ("chr2:506-506", [("GRCh38#0#chr2[500]", 3, 505, 510, 0, 1)]),
    ],
)
def test_regions_are_on_the_contig(parts, region, want):
    found = pipelines.coord2node(parts, region).select("walk", "node", "start", "end", "off_start", "off_end").collect()
    assert sorted(map(tuple, found)) == want


def test_nodes_are_on_the_contig(spark, parts):
    found = pipelines.node2coord(parts, spark.createDataFrame([(1,), (3,)], "node long")).collect()
    assert {tuple(r) for r in found} == {("GRCh38#0#chr1", 1, 5, 9), ("GRCh38#0#chr1[1000]", 1, 1000, 1004), ("GRCh38#0#chr1[1000]", 3, 1010, 1014), ("GRCh38#0#chr2[500]", 3, 505, 509)}


def test_the_longest_fragment_that_meets_the_region_anchors(parts):
    inside = pipelines.anchored_walks(parts, "chr1:1-10").select("walk", "node").collect()
    assert {tuple(r) for r in inside if r["walk"] == "GRCh38#0#chr1"} == {("GRCh38#0#chr1", 0), ("GRCh38#0#chr1", 1)}
    inside = pipelines.anchored_walks(parts, "chr1:1006-1015").select("walk", "node").collect()
    assert ("HG1#1#chr1", 2) in {tuple(r) for r in inside} and ("HG1#1#chr1", 1) not in {tuple(r) for r in inside}


def test_sequences_start_on_the_contig(parts):
    records = {r["file"]: r["record"].split("\n")[1] for r in pipelines.make_sequence(parts, "chr1:1003-1007").collect()}
    assert records["GRCh38_0_chr1[1000]_1003-1007.fa"] == "CCCGG"


def test_a_repeated_segment_keeps_the_one_with_a_sequence(parts):
    assert [r["seq"] for r in parts["nodes"].where("name = '4'").collect()] == ["TTTTT"]


def test_lines_without_a_start(spark):
    rows = spark.createDataFrame([("W", ["W", "s", "1", "c", "*", "*", ">1"])], "kind string, fields array<string>")
    assert [(r["walk"], r["start"]) for r in gfa.walk_steps(rows).collect()] == [("s#1#c", None)]
