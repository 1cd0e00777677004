"""Rules of panels, and names on intervals."""

from graphloom.operators import snarls, windows


def test_broken_rules(spark):
    sites = [("ok", "acyclic", None), ("in", "acyclic", "ok"), ("lost", "acyclic", "ok"), ("odd", "acyclic", "ok"), ("ring", "cyclic", "ok"), ("leaf", "acyclic", None), ("none", "acyclic", None), ("loop", "cyclic", None), ("gap", "acyclic", None), ("nan", "acyclic", None)]
    topology = spark.createDataFrame(sites, "snarl string, kind string, parent string")
    panel = "site string, idx long, frequency double"
    flat = [("ok", 0, 0.5), ("ok", 1, 0.5), ("in", 0, 1.0), ("lost", 0, 1.0), ("odd", 0, 1.0), ("leaf", 0, -1.0), ("leaf", 1, 2.0), ("loop", 0, 1.0), ("gap", 0, 0.5), ("gap", 2, 0.5), ("nan", 0, float("nan"))]
    routes = [("ok", 0, 0.5), ("ok", 1, 0.5), ("leaf", 0, 0.0), ("loop", 0, 1.0)]
    allowed = [("ok", "in", [0, 1]), ("ok", "odd", [2]), ("ok", "ring", [1])]
    found = snarls.broken_rules(topology, spark.createDataFrame(flat, panel), spark.createDataFrame(routes, panel), spark.createDataFrame(allowed, "snarl string, child string, allowed array<long>"))
    assert {tuple(r) for r in found.collect()} == {
        ("lost", "child without routes of its parent"), ("odd", "unknown route of the parent"), ("leaf", "frequencies of alleles"),
        ("leaf", "routes without children"), ("leaf", "frequencies of routes"), ("none", "site without alleles"), ("loop", "cyclic site with alleles"),
        ("loop", "cyclic site with routes"), ("gap", "gap in alleles"), ("nan", "frequencies of alleles"),
    }


def test_a_panel_that_was_inferred_breaks_no_rule(spark):
    topology = spark.createDataFrame([("s", "acyclic", 1, 4, None), ("t", "cyclic", 6, 9, None)], "snarl string, kind string, entry long, exit long, parent string")
    visits = {"a": [1, 2, 4, 6, 7, 9], "b": [1, 3, 4, 6, 7, 7, 9]}
    walks = spark.createDataFrame([(w, k, n, True) for w, nodes in visits.items() for k, n in enumerate(nodes)], "walk string, step long, node long, fwd boolean")
    found = snarls.panel(walks, topology)
    alleles = found["flat"].join(topology.where("kind <> 'cyclic'").select("snarl"), found["flat"]["site"] == topology["snarl"], "left_semi")
    assert snarls.broken_rules(topology, alleles, found["skeleton"], found["allowed"]).isEmpty()


def test_names_on_intervals_in_buckets(spark):
    intervals = [(-30, -20), (0, 5), (5, 5), (5, 40), (39, 41), (100, 90), (-5, 200)]
    names = [("a", 0, 5), ("b", 4, 40), ("c", -25, -20), ("d", 41, 41), ("e", 60, 150)]
    want = sorted((s, e, n) for s, e in intervals for n, lo, hi in names if s < hi and e > lo)
    rows, labels = spark.createDataFrame(intervals, "start long, end long"), spark.createDataFrame(names, "name string, lo long, hi long")
    for bucket in (1, 7, 1 << 16):
        assert sorted(map(tuple, windows.labelled(rows, labels, bucket).select("start", "end", "name").collect())) == want


def test_diploid_vectors_of_two_lengths_are_refused(spark):
    import pytest

    from graphloom.operators import alleles

    schema = "site string, hap long, column long, value double"
    left = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, None), ("b", 1, 0, None)], schema)
    right = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 1, 2.0), ("b", 1, 0, None)], schema)
    got = alleles.diploid_sites(left, right, ["site", "hap"]).collect()
    assert {tuple(r) for r in got} == {("a", 1, 0, 2.0), ("a", 1, 1, 2.0), ("b", 1, 0, None)}
    with pytest.raises(ValueError, match="2 and 1 columns"):
        alleles.diploid_sites(left, right.where("not (site = 'a' and column = 1)"), ["site", "hap"])


def test_one_walk_over_all_sites_is_the_levels_way(spark):
    import random

    import pytest

    rng = random.Random(6)
    rows = [(k, rng.choice(["acyclic", "acyclic", "cyclic"]), rng.choice([None, rng.randrange(k)]) if k else None, rng.choice([None, rng.randrange(1, 6)]), rng.choice([None, 1, 2, 3])) for k in range(60)]
    schema = "snarl long, kind string, parent long, alleles long, skeletons long"
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, schema).selectExpr(f"cast(snarl as {kind}) snarl", "kind", f"cast(parent as {kind}) parent", "alleles", "skeletons")
        levels, sites = snarls.sites_at_once(df)
        assert sorted(map(repr, sites.collect())) == sorted(map(repr, snarls.feature_sites(df).select(sites.columns).collect()))
        columns = ["snarl", "depth", "path"]
        assert sorted(map(repr, levels.select(columns).collect())) == sorted(map(repr, snarls.tree(df).select(columns).collect()))
    for bad, message in (([*rows, rows[0]], "twice"), ([(1, "acyclic", 9, 1, 1)], "missing"), ([(1, "acyclic", 2, 1, 1), (2, "acyclic", 1, 1, 1)], "cycle")):
        with pytest.raises(snarls.TopologyError, match=message):
            snarls.sites_at_once(spark.createDataFrame(bad, schema))
    assert snarls.sites_at_once(spark.createDataFrame([], schema))[1].count() == 0
