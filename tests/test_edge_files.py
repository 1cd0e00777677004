"""Binary edge files: byte ranges, cut-off pairs, many files, filters, and parts that are named when all are done."""

import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.sources import edge_files as E
from graphloom.sources import sinks, tables


def rows(df):
    return sorted(map(tuple, df.select("src", "dst").collect()))


def some(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**32, (n, 2), dtype=np.int64)


def test_a_cut_off_pair_and_small_splits(spark, tmp_path):
    pairs = some(1000)
    (tmp_path / "a.bin").write_bytes(pairs[:600].astype("<u4").tobytes() + b"\x01\x02\x03")
    (tmp_path / "b.bin").write_bytes(pairs[600:].astype("<u4").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"12345678")
    want = sorted(map(tuple, pairs.tolist()))
    assert rows(tables.edge_list(spark, str(tmp_path))) == want
    assert rows(tables.edge_list(spark, f"file:{tmp_path}/*.bin")) == want
    assert rows(tables.edge_list(spark, f"{tmp_path}/b.bin")) == sorted(map(tuple, pairs[600:].tolist()))
    E.registered(spark)
    small = spark.read.format(E.NAME).option("split", 100).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == -(-1000 // (100 // 8)) and rows(small) == want


def test_stretches_hold_every_pair_once():
    files = [("a", 8 * 10 + 5), ("b", 3), ("c", 8 * 25), ("d", 8)]
    parts = E.dealt(files, 8 * 12)
    assert [sum(e - a for _, a, e in p.parts) for p in parts] == [12, 12, 12]
    assert sorted((n, k) for p in parts for n, a, e in p.parts for k in range(a, e)) == [(n, k) for n, s in files for k in range(s // 8)]
    assert len(E.dealt([("big", 80 << 30)], E.SPLIT)) == 1280


def test_filters_are_applied_while_reading(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(some(5000).astype("<u4").tobytes())
    edges = tables.edge_list(spark, str(tmp_path))
    asked = edges.where("src between 1000000 and 3000000000 and dst < 2000000000 and dst % 2 = 0")
    want = sorted((a, b) for a, b in some(5000).tolist() if 1000000 <= a <= 3000000000 and b < 2000000000 and b % 2 == 0)
    assert rows(asked) == want
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "% 2" in plan and "1000000" not in plan and "2000000000" not in plan  # what is left for Spark to filter
    reader = E.EdgeReader(str(tmp_path), E.SPLIT)
    from pyspark.sql import datasource as ds

    left = reader.pushFilters([ds.GreaterThan(("src",), 5), ds.LessThanOrEqual(("dst",), 9), ds.In(("src",), (1, 2)), ds.EqualTo(("dst",), None)])
    assert [type(f).__name__ for f in left] == ["In", "EqualTo"]
    assert (reader.bounds.low["src"], reader.bounds.high["dst"]) == (6, 9)


def test_bounds_beyond_32_bits(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([[0, 2**32 - 1]], "<u4").tobytes())
    edges = tables.edge_list(spark, str(tmp_path))
    assert rows(edges.where(f"dst >= {2**32 - 1}")) == [(0, 2**32 - 1)]
    assert rows(edges.where(f"dst > {2**40}")) == [] and rows(edges.where("src < -1")) == []


def test_many_files_are_one_relation(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"{k:05d}.bin").write_bytes(np.array([[k, k + 1]], "<u4").tobytes())
    began = time.monotonic()
    edges = tables.edge_list(spark, str(tmp_path))
    assert edges.agg(F.sum("src"), F.count("*")).first()[:] == (3000 * 2999 // 2, 3000)
    assert time.monotonic() - began < 30
    assert edges.rdd.getNumPartitions() == 1


def test_round_trip_and_append(spark, tmp_path):
    df = spark.createDataFrame([(a, b) for a, b in some(2000, 3).tolist()], "src long, dst long").repartition(5)
    path = f"{tmp_path}/out"
    sinks.edge_files(df, path)
    assert rows(tables.edge_list(spark, path)) == rows(df)
    sinks.edge_files(df.limit(10), path)
    assert tables.edge_list(spark, path).count() == 2010
    df.limit(7).write.format(E.NAME).mode("overwrite").save(path)
    assert tables.edge_list(spark, path).count() == 7
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_job")]


@pytest.mark.parametrize("bad", [[(1, None)], [(1, 2**32)], [(-1, 0)]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([(1, 2)] * 10 + bad, "src long, dst long").repartition(2)
    with pytest.raises(PySparkException):
        sinks.edge_files(df, path)
    left = list((tmp_path / "out").rglob("*")) if (tmp_path / "out").exists() else []
    assert not [x for x in left if x.is_file()]


def test_a_missing_folder(spark, tmp_path):
    with pytest.raises(PySparkException):
        tables.edge_list(spark, f"{tmp_path}/nothing").collect()
