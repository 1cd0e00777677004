"""Every query with SQL, held against DuckDB on the smallest tables; the others run and keep their schema."""

import os

import duckdb
import pytest

from graphloom.plans import queries as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["window_spectrum", "entropy_exact_window", "spectral_embedding", "entropy_hutchinson", "encode_walks", "force_layout"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["row", "col", "value"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
