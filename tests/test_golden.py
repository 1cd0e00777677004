"""Stated results on small fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import alleles, coords, graph, index, snarls, spectral, windows
from graphloom.plans import pipelines
from graphloom.sources import gfa, sinks, tables
from graphloom.streaming import ingest

GFA = "\n".join(
    ["H\tVN:Z:1.0"]
    + [f"S\t{n}\t{s}" for n, s in ((1, "ACG"), (2, "T"), (3, "GG"), (4, "CATT"))]
    + [f"L\t{a}\t+\t{b}\t{o}\t0M" for a, b, o in ((1, 2, "+"), (2, 3, "+"), (3, 4, "+"), (1, 3, "-"), (9, 1, "+"))]
    + ["L\t1\t+\t2", "P\tgrch38#0#chr1\t1+,2+,3+,4+\t*", "W\tHG1\t1\tchr1\t0\t9\t>1<3>4"]
) + "\n"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def dense(df, n):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r["row"], r["col"]] = r["value"]
    return m.tolist()


def test_laplacians(spark):
    assert dense(graph.laplacian(edges(spark, [(0, 1), (1, 2), (0, 2)])), 3) == [[2, -1, -1], [-1, 2, -1], [-1, -1, 2]]
    assert dense(graph.laplacian(edges(spark, [(0, 1)] * 3), loops="degree"), 2) == [[3, -3], [-3, 3]]
    loop = edges(spark, [(0, 0), (0, 1), (1, 0)])
    assert dense(graph.laplacian(loop, loops="degree"), 2) == [[4, -2], [-2, 2]]
    assert dense(graph.laplacian(loop), 2) == [[2, -2], [-2, 2]]
    assert dense(graph.laplacian(loop, loops="skip", multi="drop"), 2) == [[1, -1], [-1, 1]]
    assert graph.in_range(edges(spark, [(0, 1), (1, 2), (2, 3)]), 1, 2).count() == 1
    assert graph.laplacian(edges(spark, [])).count() == 0


def test_spectra(spark):
    coo = graph.laplacian(edges(spark, [(1, 2), (2, 3), (1, 3)])).withColumn("win", F.lit(0).cast("bigint"))
    values = [r["eigenvalue"] for r in spectral.spectra(coo, "win").orderBy("k").collect()]
    assert np.allclose(values, [0, 3, 3])
    score = spectral.block_scores(coo, "win").first()["score"]
    assert math.isclose(score, math.log(2) / math.log(3))
    with pytest.raises(spectral.SpectrumError):
        spectral.entropy_score(np.array([-2.0, 1.0, 0.5]))
    with pytest.raises(spectral.SpectrumError):
        spectral.entropy_score(np.array([]))
    assert spectral.entropy_score(np.zeros(3), strict=False) == 0.0
    assert math.isnan(spectral.entropy_score(np.array([2.0]), strict=False))


def test_lanczos_and_probes():
    n = 300
    m = np.diag(np.full(n, 2.0)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
    m[0, 0] = m[-1, -1] = 1
    exact = np.linalg.eigvalsh(m)
    values, vectors = spectral.lanczos(lambda x: m @ x, n, 4, extra=400)
    assert np.allclose(values, exact[:4], atol=1e-6)
    assert np.allclose(m @ vectors[:, 1], values[1] * vectors[:, 1], atol=1e-4)
    score = spectral.hutchinson(lambda x: m @ x, n, np.trace(m), 4.0)
    assert abs(score - spectral.entropy_score(exact, strict=False)) < 0.01
    c = spectral.chebyshev(lambda x: x * x, 2.0, 8)
    assert np.allclose(np.polynomial.chebyshev.chebval(0.5, c), 1.5**2)


def test_windows(spark):
    found = sorted(map(tuple, windows.node_windows(spark, 0, 10, 4, 2).collect()))
    assert found == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert sorted(map(tuple, windows.node_windows(spark, 0, 11, 4, 0).collect())) == [(0, 4), (4, 8), (7, 11)]
    with pytest.raises(ValueError):
        windows.node_windows(spark, 0, 10, 4, 4)
    e = [(a, b) for a in range(12) for b in range(12) if (a * 7 + b) % 5 == 0]
    for start, end, size, overlap in ((0, 11, 4, 1), (2, 12, 5, 0), (0, 12, 4, 2)):
        wins = windows.node_windows(spark, start, end, size, overlap).collect()
        want = sorted((w["start"], a, b) for w in wins for a, b in e if all(w["start"] <= x < w["end"] for x in (a, b)))
        assert sorted(map(tuple, windows.edges_in_windows(edges(spark, e), start, end, size, overlap).collect())) == want


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert tuple(one(S.region(F.lit("chr1:1-1000")))) == ("chr1", 0, 1000)
    assert tuple(one(S.region(F.lit("chr10:0-548")))) == ("chr10", 0, 549)
    assert one(S.region(F.lit("chr1:200-100"))) is None
    assert one(S.region(F.lit("chr1"))) is None
    assert one(S.reverse_complement(F.lit("ACGTNacg"))) == "cgtNACGT"
    assert one(S.oriented_slice(F.lit("AACGT"), F.lit(False), F.lit(0), F.lit(2))) == "AC"
    assert one(S.wrapped(F.lit("A" * 120))) == "A" * 60 + "\n" + "A" * 60
    assert one(F.size(S.chunks(F.lit("A" * 1025)))) == 2
    assert one(S.chunks(F.lit(""))) == [""]
    assert one(S.strict_u32(F.lit("4294967296"))) is None
    assert one(S.ascii_trim(F.lit("\t x \r\n"))) == "x"
    assert one(S.first_largest(F.array(F.lit(0.2), F.lit(float("nan")), F.lit(0.4), F.lit(0.4)))) == 2
    assert one(S.unit(F.lit(1.5))) == 1.0 and one(S.unit(F.lit(float("inf")))) is None
    assert tuple(one(S.window_of_name(F.lit("out/laplacian_000010_000050_values.npy")))) == (10, 50)


def test_index(spark):
    names = spark.createDataFrame([("10",), ("9",), ("10",)], "name string")
    assert sorted(map(tuple, index.node_index(names).collect())) == [("10", 1), ("9", 0)]
    assert sorted(map(tuple, index.node_index(names, numeric=False).collect())) == [("10", 0), ("9", 1)]
    ids = spark.createDataFrame([(7,), (5,), (6,)], "id long")
    assert sorted(map(tuple, index.contiguous_index(ids).collect())) == [(5, 0), (6, 1), (7, 2)]
    assert sorted(map(tuple, index.contiguous_index(ids.where("id <> 6")).collect())) == [(5, 0), (7, 1)]


def test_graph_text(spark, tmp_path):
    path = tmp_path / "g.gfa"
    path.write_text(GFA)
    rows = gfa.lines(spark, str(path))
    assert gfa.segments(rows).count() == 4
    assert gfa.links(rows).count() == 5
    parts = pipelines.bundle(spark, str(path))
    assert parts["edges"].count() == 4
    walked = {tuple(r) for r in parts["walks"].select("walk", "step", "node", "fwd").collect()}
    assert ("HG1#1#chr1", 1, 2, False) in walked and len(walked) == 7
    hits = pipelines.coord2node(parts, "chr1:4-5").orderBy("step").collect()
    assert [(h["node"], h["off_start"], h["off_end"]) for h in hits] == [(1, 0, 1), (2, 0, 1)]
    records = {r["file"]: r["record"] for r in pipelines.make_sequence(parts, "chr1:2-7").collect()}
    assert records["grch38_0_chr1_2-7.fa"] == ">grch38#0#chr1:2-7\nCGTGGC"
    assert records["HG1_1_chr1_2-7.fa"] == ">HG1#1#chr1:2-7\nCGCCCA"
    assert pipelines.region_score(parts, "chr1:1-10").first()["nodes"] == 4
    assert {tuple(r) for r in pipelines.node2coord(parts, spark.createDataFrame([(3,)], "node long")).collect()} == {("grch38#0#chr1", 3, 6, 9)}
    assert {r["walk"] for r in pipelines.anchored_walks(parts, "chr1:1-10").collect()} == {"grch38#0#chr1", "HG1#1#chr1"}
    assert pipelines.node_report(pipelines.coord2node(parts, "chr1:1-10")).first()["ranges"] == "0-3"
    pipelines.convert(spark, str(path), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 4
    q = ingest.run(ingest.degree_stream(ingest.link_stream(spark, str(tmp_path / "in"))) if (os.makedirs(tmp_path / "in"), (tmp_path / "in" / "a.gfa").write_text(GFA)) else None, "deg", str(tmp_path / "ck"))
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from deg").collect()} == {("1", 3), ("2", 2), ("3", 3), ("4", 1), ("9", 1)}


def test_binary_and_text_files(spark, tmp_path):
    e = edges(spark, [(3, 4), (1, 2)])
    (tmp_path / "e.bin").write_bytes(b"".join(sinks.edge_bytes(e)) + b"\x01")
    assert sorted(map(tuple, tables.edge_list(spark, str(tmp_path / "e.bin")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "t.tsv").write_text("# c\ns1\tacyclic\t1\t4\t.\tchr1:1-2\n\ns2\tcyclic\t2\t3\ts1\n")
    t = {r["snarl"]: r for r in tables.topology(spark, str(tmp_path / "t.tsv")).collect()}
    assert t["s1"]["parent"] is None and t["s2"]["parent"] == "s1" and t["s2"]["region"] is None
    (tmp_path / "bad.tsv").write_text("s1\tacyclic\t1\n")
    with pytest.raises(Exception, match="five fields"):
        tables.topology(spark, str(tmp_path / "bad.tsv")).collect()
    sinks.matrix_csv(graph.adjacency(edges(spark, [(0, 1)])), 2, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["0.0,1.0", "1.0,0.0"]
    assert sorted(map(tuple, tables.matrix(spark, str(tmp_path / "m/*.txt")).where("value > 0").collect())) != []
    np.save(tmp_path / "window_5_9_v.npy", np.array([0.5, 1.5]))
    assert sorted(tuple(r)[1:] for r in tables.arrays(spark, str(tmp_path / "window_5_9_v.npy")).collect()) == [(5, 9, 0, 0.5), (5, 9, 1, 1.5)]
    (tmp_path / "r.csv").write_text("1,5\nx,y\n7,9\n")
    assert sorted(map(tuple, tables.ranges(spark, str(tmp_path / "r.csv")).collect())) == [(1, 5), (7, 9)]
    (tmp_path / "a.paf").write_text("q\t10\t0\t9\t+\tt\t20\t1\t10\t8\t9\t60\tcg:Z:9M\n")
    assert tables.alignments(spark, str(tmp_path / "a.paf")).first()["tags"] == ["cg:Z:9M"]
    records = [{"feature_id": 0, "entry": 1, "exit": 4, "k": 2, "cyclic": False, "parent_feature": None}, {"feature_id": 1, "entry": 2, "exit": 3, "k": 0, "cyclic": True, "parent_feature": 0}]
    a, b = sinks.catalog_bytes(records, [[[1, 2], [1]], []])
    back, lists = tables.read_catalog(a, b)
    assert lists == [[1, 2], [1]] and back["entry"].tolist() == [1, 2] and len(a) == 24 + 2 * 32
    for broken in ((a[:20], b), (a[:-1], b), (a, b[:-1]), (b"XXXX" + a[4:], b)):
        with pytest.raises(tables.CatalogError):
            tables.read_catalog(*broken)
    values = {k: "1" for k in tables.MANIFEST_KEYS}
    sinks.manifest(spark, values, str(tmp_path / "manifest"))
    assert tables.manifest(spark, str(tmp_path / "manifest")) == values
    with pytest.raises(tables.CatalogError):
        sinks.manifest(spark, {**values, "graph_build_id": "a\tb"}, str(tmp_path / "m2"))
    csr = sinks.csr_arrays([(5, 5, 1.0), (5, 9, -1.0), (9, 5, -1.0), (9, 9, 1.0)])
    assert csr["row_ptr"].tolist() == [0, 2, 4] and csr["col_indices"].tolist() == [0, 1, 0, 1]


def panel_fixture(spark):
    walks = {"h1": [1, 2, 3, 4], "h2": [1, 5, 4], "h3": [1, 2, 6, 3, 4], "h4": [1, 2, 3, 4], "h5": [1, 5, 4], "h6": [1, 2, 6, 3, 4]}
    rows = [(w, k, n, True) for w, nodes in walks.items() for k, n in enumerate(nodes)]
    w = spark.createDataFrame(rows, "walk string, step long, node long, fwd boolean")
    t = spark.createDataFrame([("outer", "acyclic", 1, 4, None), ("inner", "acyclic", 2, 3, "outer")], "snarl string, kind string, entry long, exit long, parent string")
    return w, t


def test_panel_and_encoding(spark):
    w, t = panel_fixture(spark)
    found = snarls.panel(w, t)
    flat = {(r["site"], r["label"]): r["frequency"] for r in found["flat"].collect()}
    assert [k for k in flat if k[0] == "outer"].__len__() == 3 and all(math.isclose(v, 1 / 3) for k, v in flat.items() if k[0] == "outer")
    skeleton = sorted((r["idx"], r["frequency"]) for r in found["skeleton"].collect())
    assert len(skeleton) == 2 and math.isclose(skeleton[0][1], 2 / 3)
    assert [tuple(r) for r in found["allowed"].collect()] == [("outer", "inner", [0])]
    cells, sites = index.stored(snarls.encoded(w, t)), spark.createDataFrame([(0, 1), (1, 2)], "feature_start long, feature_end long")
    encoded = {(r["walk"], r["feature"]): r["value"] for r in cells.collect()}
    assert encoded["h2", 0] == 1.0 and ("h2", 1) not in encoded
    assert (encoded["h1", 0], encoded["h1", 1]) == (0.0, 0.0)
    assert encoded["h3", 1] == 1.0
    whole = {(r["walk"], r["feature"]): r["value"] for r in snarls.grid(cells, w.select("walk").distinct(), sites).collect()}
    assert len(whole) == 12 and whole["h2", 1] is None and all(whole[k] == v for k, v in encoded.items())


def test_spans(spark):
    cases = {"a": [1, 9, 2, 2], "b": [1, 9, 2, 1, 8, 2], "c": [1, 9, 1, 8, 2], "d": [7, 3], "e": [3, 5, 1]}
    rows = [(w, k, n, True) for w, nodes in cases.items() for k, n in enumerate(nodes)]
    w = spark.createDataFrame(rows, "walk string, step long, node long, fwd boolean")
    t = spark.createDataFrame([("x", "acyclic", 1, 2, None), ("y", "acyclic", 7, 8, None), ("z", "acyclic", 1, 3, None)], "snarl string, kind string, entry long, exit long, parent string")
    got = {(r["walk"], r["snarl"]): (r["start"], r["end"], r["ambiguous"]) for r in snarls.spans(snarls.boundary_hits(w, t)).collect()}
    assert got["a", "x"][:2] == (0, 2) and not got["a", "x"][2]
    assert got["b", "x"][2]
    assert got["c", "x"] == (0, 4, False)
    assert got["d", "y"] == (0, 0, False)
    assert got["e", "z"] == (0, 2, False)


def test_topology_errors(spark):
    schema = "snarl long, kind string, entry long, exit long, parent long"
    with pytest.raises(snarls.TopologyError, match="twice"):
        snarls.tree(spark.createDataFrame([(1, "acyclic", 1, 2, None), (1, "cyclic", 3, 4, None)], schema))
    with pytest.raises(snarls.TopologyError, match="missing"):
        snarls.tree(spark.createDataFrame([(1, "acyclic", 1, 2, 9)], schema))
    with pytest.raises(snarls.TopologyError, match="cycle"):
        snarls.tree(spark.createDataFrame([(1, "acyclic", 1, 2, 2), (2, "acyclic", 1, 2, 1)], schema))


def test_pooling_and_coding(spark):
    calls = spark.createDataFrame([("s", h, label) for h, label in enumerate("AAABC")], "site string, hap long, label string")
    panel = alleles.pooled(calls)
    assert [(r["label"], r["frequency"]) for r in panel.orderBy("idx").collect()] == [("A", 0.6), ("OTHER", 0.4)]
    assert {r["label"]: r["idx"] for r in alleles.label_map(calls).collect()} == {"A": 0, "B": 1, "C": 1}
    four = spark.createDataFrame([("s", l, n, n / 10, i) for i, (l, n) in enumerate((("a", 2), ("b", 2), ("c", 4), ("d", 2)))], "site string, label string, n long, frequency double, idx long")
    one = alleles.dosages(spark.createDataFrame([("s", 1, 3)], "site string, hap long, idx long"), four)
    assert [r["value"] for r in one.orderBy("column").collect()] == [0.0, 0.0, 1.0]
    left = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, None)], "f long, value double")
    right = spark.createDataFrame([(0, 1.0), (1, None), (2, 1.0)], "f long, value double")
    assert [r["value"] for r in alleles.diploid(left, right, ["f"]).orderBy("f").collect()] == [2.0, 0.0, 1.0]


def test_repeats(spark):
    rows = [("w", k, n, True) for k, n in enumerate([1, 3, 2, 3, 2])]
    w = spark.createDataFrame(rows, "walk string, step long, node long, fwd boolean")
    t = spark.createDataFrame([("x", "cyclic", 1, 2, None)], "snarl string, kind string, entry long, exit long, parent string")
    assert snarls.repeat_counts(w, t).first()["copies"] == 2


def test_encoding_of_node_values(spark):
    w, t = panel_fixture(spark)
    # skeletons of outer: {inner} between 1 and 4 (4 walks), and 1, 5, 4 (2); inner: 2, 3 and 2, 6, 3, equally often
    sure = {"a": [1, 2, 3, 4], "b": [1, 5, 4], "c": [1, 2, 6, 3, 4], "d": [1, 2, 3]}
    rows = [(i, n, 1.0) for i, nodes in sure.items() for n in nodes]
    rows += [("e", n, v) for n, v in ((1, 1.0), (2, 0.5), (6, 0.25), (3, 0.5), (4, 1.0), (5, 0.5))] + [("f", 1, 0.5), ("f", 4, 0.5)]
    values = spark.createDataFrame(rows, "individual string, node long, value double")
    got = {(r["individual"], r["feature"]): r["value"] for r in snarls.encoded_values(values, w, t).collect()}
    # c has all nodes of both alleles of inner, and the first counts;
    # of d outer's exit has no value, so neither site is traversed; of f inner's boundary has none
    assert {k: v for k, v in got.items() if k[0] in "abcd"} == {("a", 0): 0.0, ("a", 1): 0.0, ("b", 0): 1.0, ("c", 0): 0.0, ("c", 1): 0.0}
    # e: skeletons 1+, {inner}, 4+ with mean 1 and 1+, 5+, 4+ with mean 5/6; of inner 2, 3 has no node of its own
    assert math.isclose(got["e", 0], (5 / 6) / (1 + 5 / 6)) and math.isclose(got["e", 1], 0.25 / 0.75)
    assert math.isclose(got["f", 0], (1 / 3) / (1 / 3 + 1 / 3)) and ("f", 1) not in got
    rings = spark.createDataFrame([("r", "cyclic", 1, 4, None)], t.schema)
    of = {(r["individual"], r["feature"]): r["value"] for r in snarls.encoded_values(values, w, rings).collect()}
    assert of == {("a", 0): 1.0, ("b", 0): 1.0, ("c", 0): 1.0, ("e", 0): 0.5, ("f", 0): 0.5}


def test_bounded_reach(spark):
    lens = spark.createDataFrame([(n, 3) for n in range(5)], "node long, len long")
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    start = spark.createDataFrame([(0,)], "node long")
    assert {tuple(r) for r in coords.bounded_reach(e, lens, start, 7).collect()} == {(0, 0), (1, 3), (2, 6)}
    assert {r["node"] for r in coords.bounded_reach(e, lens, start, 100, stop=1).collect()} == {0, 1}


def test_a_walk_that_leaves_the_reach_starts_anew(spark):
    visits = {"gap": [1, 2, 8, 9, 3], "clear": [1, 2, 8, 3], "again": [1, 9, 1, 2, 1, 8, 3, 1, 3], "other": [3, 9, 1]}
    rows = [(w, k, n, True) for w, nodes in visits.items() for k, n in enumerate(nodes)]
    walks = spark.createDataFrame(rows, "walk string, step long, node long, fwd boolean")
    near = spark.createDataFrame([(n,) for n in (1, 2, 3, 8)], "node long")
    got = {(r["walk"], r["step"]) for r in coords.between_anchors(walks, 1, 3, near).collect()}
    assert got == {("clear", k) for k in range(4)} | {("again", k) for k in range(2, 7)}


def test_probabilities_where_only_shared_nodes_have_values(spark):
    signatures = spark.createDataFrame([(0, i, n) for i in (0, 1) for n in (i + 1, 9)], "site long, idx long, node long")
    values = spark.createDataFrame([("a", 9, 0.5), ("b", 2, 1.0), ("b", 9, 1.0), ("c", 1, 0.0)], "individual string, node long, value double")
    got = {tuple(r) for r in alleles.signature_probabilities(values, signatures).select("individual", "site", "idx", "p").collect()}
    assert got == {("a", 0, 0, 1.0), ("b", 0, 1, 1.0), ("c", 0, 0, 1.0)}


def test_dosages_are_dealt_over_tasks(spark):
    """Haplotypes of one small file are spread before each meets all of a site's columns, which are not exchanged after."""
    panel = spark.createDataFrame([("s", k, 1 / 12) for k in range(12)], "site string, idx long, frequency double")
    called = spark.createDataFrame([("s", h, h % 12) for h in range(200)], "site string, hap long, idx long").coalesce(1)
    probs = alleles.by_panel(called.drop("idx"), panel, ["site"]).withColumn("p", F.lit(0.5))
    for rows in (alleles.dosages(called, panel), alleles.expected_dosages(probs, panel)):
        assert rows.count() == 200 * 11
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_flat_cells_are_not_exchanged(spark):
    """Scores and cells of flat alleles arise where an individual meets a site's lists; no exchange comes after."""
    panel = spark.createDataFrame([(0, "1+,2+", 0), (0, "1+,3+", 1), (0, "OTHER", 2)], "site long, label string, idx long")
    columns = spark.createDataFrame([(0, 1, 10), (0, 2, 11)], "snarl long, allele long, feature long")
    values = spark.createDataFrame([(7, 1, 1.0), (7, 3, 1.0), (8, 2, 0.3), (8, 3, 0.1)], "individual long, node long, value double")
    asked = spark.createDataFrame([(7, 0, True), (8, 0, False), (9, 0, False)], "individual long, site long, hard boolean")
    cells = snarls.flat_cells(asked, values, panel, snarls.flat_parts(panel), columns)
    got = {(r["individual"], r["feature"]): round(r["value"], 9) for r in cells.collect()}
    assert got == {(7, 10): 1.0, (7, 11): 0.0, (8, 10): 0.25, (8, 11): 0.0, (9, 10): 0.0, (9, 11): 0.0}
    above, found, _ = cells._jdf.queryExecution().executedPlan().toString().partition("Generate")
    assert found and "Exchange" not in above
