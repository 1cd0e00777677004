"""Spectra over tables, against dense solvers and closed forms."""

import numpy as np
import pytest

from graphloom.operators import generators, graph, krylov, spectral
from graphloom.plans import pipelines


def dense_of(coo):
    pdf = coo.toPandas()
    nodes, m = spectral.dense(pdf)
    return nodes, m


def random_graph(spark, n, m, seed):
    e = np.random.default_rng(seed).integers(0, n, (m, 2))
    return graph.laplacian(spark.createDataFrame([(int(a) * 7, int(b) * 7) for a, b in e], "src long, dst long"))


def test_a_ring_of_cliques(spark):
    n, digits = 60, 1
    coo = graph.laplacian(generators.digit_ring(spark.range(n), digits))
    want = sorted({round(10 * a + 2 - 2 * np.cos(2 * np.pi * j / 6), 8) for a in range(2) for j in range(6)})
    assert np.allclose(sorted(np.unique(np.linalg.eigvalsh(dense_of(coo)[1]).round(8))), want, atol=1e-7)
    values, vectors = krylov.lowest(coo, 20)
    assert np.allclose([r["eigenvalue"] for r in values.orderBy("k").collect()], want, atol=1e-8)  # the space closes: each value once
    nodes, m = dense_of(coo)
    pdf = vectors.toPandas()
    for r in values.collect():
        x = pdf[pdf["k"] == r["k"]].set_index("node")["entry"].reindex(nodes).to_numpy()
        assert abs(np.linalg.norm(x) - 1) < 1e-8 and np.linalg.norm(m @ x - r["eigenvalue"] * x) < 1e-7


def test_settled_before_the_space_closes(spark):
    coo = random_graph(spark, 50, 400, 5)
    nodes, m = dense_of(coo)
    exact = np.linalg.eigvalsh(m)
    values, _ = krylov.lowest(coo, 3, tolerance=1e-6)
    rows = values.orderBy("k").collect()
    assert np.allclose([r["eigenvalue"] for r in rows], exact[:3], atol=1e-6) and all(r["residual"] < 1e-4 for r in rows)


def test_nothing_and_one_node(spark):
    none = spark.createDataFrame([], "row long, col long, value long")
    assert krylov.lowest(none, 3)[0].count() == 0 and krylov.lowest(none, 3)[1].count() == 0
    one = spark.createDataFrame([(4, 4, 2)], "row long, col long, value long")
    assert [tuple(r)[:2] for r in krylov.lowest(one, 3)[0].collect()] == [(0, 2.0)]
    assert krylov.probe_score(one).first()[:] == (1, 0.0)


@pytest.mark.parametrize("degree", [8, 9])
def test_probes_are_those_of_one_block(spark, degree):
    coo = random_graph(spark, 40, 120, 3)
    nodes, m = dense_of(coo)
    score = krylov.probe_score(coo, degree, probes=4).first()
    from pyspark.sql import functions as F

    signs = spark.createDataFrame([(int(n),) for n in nodes], "node long").select("node", *(F.when(F.xxhash64(F.lit(11), F.lit(p), "node") % 2 == 0, 1.0).otherwise(-1.0).alias(f"z{p}") for p in range(4))).toPandas().set_index("node").loc[nodes].to_numpy()
    top = max(1.0, np.abs(m).sum(axis=1).max())
    c = spectral.chebyshev(lambda x: np.where(x > 1e-15, x * np.log(np.maximum(x, 1e-300)), 0.0), top, degree)
    values, vectors = np.linalg.eigh(m)
    f = np.polynomial.chebyshev.chebval(2 / top * values - 1, c)
    estimate = ((vectors.T @ signs) ** 2 * f[:, None]).sum() / 4
    want = max(0.0, (np.log(np.trace(m)) - estimate / np.trace(m)) / np.log(len(m)))
    assert score["nodes"] == len(m) and abs(score["score"] - want) < 1e-9


def test_a_range_beyond_one_task(spark, monkeypatch):
    edges = generators.digit_ring(spark.range(60), 1)
    exact = pipelines.lowest_eigenvalues(edges, 0, 100, 2).orderBy("k").collect()
    monkeypatch.setattr(spectral, "FULL_ORDER", 10)
    far = pipelines.lowest_eigenvalues(edges, 0, 100, 2).orderBy("k").collect()
    assert abs(far[0]["eigenvalue"] - exact[0]["eigenvalue"]) < 1e-8 and far[0]["residual"] < 1e-6


def test_a_step_writes_no_more_than_the_one_before(spark):
    """Vectors found before are not written anew, and sums near the diagonal are added up before they are exchanged."""
    from pathlib import Path

    from graphloom.operators.index import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    n = 20_000
    space, steps = krylov.Space(graph.laplacian(generators.digit_ring(spark.range(n), 1))), []
    for _ in range(8):
        before = size()
        space.step()
        steps.append(size() - before)
    assert max(steps) < 1.2 * min(steps) and max(steps) < 3 * 8 * n


def test_nodes_far_apart(spark):
    """Ids with wide gaps go by their ranks; the pairs are those of the dense matrix."""
    e = np.random.default_rng(8).integers(0, 12, (40, 2))
    coo = graph.laplacian(spark.createDataFrame([(int(a) * 10**12, int(b) * 10**12) for a, b in e], "src long, dst long"))
    nodes, m = dense_of(coo)
    values, vectors = krylov.lowest(coo, 2, tolerance=1e-8)
    pdf = vectors.toPandas()
    for r in values.collect():
        x = pdf[pdf["k"] == r["k"]].set_index("node")["entry"].reindex(nodes).to_numpy()
        assert abs(np.linalg.norm(x) - 1) < 1e-8 and np.linalg.norm(m @ x - r["eigenvalue"] * x) < 1e-5


def test_vectors_before_are_read_now_and_then(spark):
    """A step reads the last two vectors, and all of them only where they lose their right angles."""
    sc = spark.sparkContext
    nothing = sc._gateway.new_array(sc._jvm.double, 0)

    def read():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, nothing, None)
        return sum(stages.apply(k).inputBytes() for k in range(stages.size()))

    n = 4000
    hub = [(0, 7 * k) for k in range(1, n)]
    coo = graph.laplacian(spark.createDataFrame([*hub, *((7 * k, 7 * (k + 1)) for k in range(n - 1))], "src long, dst long"))
    space, plain = krylov.Space(coo), []
    for _ in range(14):
        before, reads = read(), space.reads
        space.step()
        plain += [read() - before] if space.reads == reads else []
    assert 0 < space.reads < 14 and max(plain) < 1.5 * min(plain)
    q = np.array([np.sum([np.frombuffer(r["x"]) @ np.frombuffer(s["x"]) for r, s in zip(a, b)]) for a in slabs_of(space) for b in slabs_of(space)]).reshape(14, 14)
    assert np.abs(q - np.eye(14)).max() < 1e-7


def slabs_of(space):
    """The rows of each vector, by slab."""
    rows = sorted(space.rows.collect(), key=lambda r: (r["number"], r["slab"]))
    return [[r for r in rows if r["number"] == k] for k in range(len(space.alpha))]


def test_entries_are_packed(spark):
    """A value that most entries share is not written for each of them."""
    coo = graph.laplacian(generators.digit_ring(spark.range(20_000), 2))
    space = krylov.Space(coo)
    size = sum(len(v) for r in space.matrix.drop("slab").collect() for v in r)
    assert size < 7 * coo.count()
