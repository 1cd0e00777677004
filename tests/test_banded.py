"""Narrow orders, counts of eigenvalues on the band, and blocks, against dense solvers."""

import numpy as np
import pytest

from graphloom.operators import banded, graph


def laplacian(n, edges):
    m = np.zeros((n, n))
    for a, b in edges:
        if a != b:
            m[[a, b], [b, a]] = -1
    return m - np.diag(m.sum(axis=1))


def random_matrix(n, edges, seed):
    return laplacian(n, np.random.default_rng(seed).integers(0, n, (edges, 2)))


def reordered(m):
    row, col = np.nonzero(m)
    place = banded.narrow_order(len(m), row, col)
    return place, banded.band_of(len(m), place[row], place[col], m[row, col])


CASES = {"path": laplacian(30, [(7 * k % 30, 7 * (k + 1) % 30) for k in range(29)]), "ring": laplacian(31, [(k * 12 % 31, (k + 1) * 12 % 31) for k in range(31)]), "sparse": random_matrix(40, 45, 1), "dense": random_matrix(15, 200, 2), "grid": laplacian(48, [(k, k + 1) for k in range(48) if k % 6 < 5] + [(k, k + 6) for k in range(42)])}


@pytest.mark.parametrize("name", CASES)
def test_band(name):
    m = CASES[name]
    place, band = reordered(m)
    assert sorted(place) == list(range(len(m)))
    exact = np.linalg.eigvalsh(m)
    assert np.allclose(banded.lowest(band, len(m)), exact, atol=1e-9)
    shifts = np.concatenate([exact[:-1] + np.diff(exact) / 2, [-1.0, exact[-1] + 1]])
    clear = np.abs(shifts[:, None] - exact).min(axis=1) > 1e-6
    assert (banded.below(band, shifts)[clear] == (exact < shifts[:, None]).sum(axis=1)[clear]).all()
    full = np.zeros_like(m)
    for i in range(len(m)):
        for k in range(band.shape[1]):
            if i + k < len(m):
                full[i, i + k] = full[i + k, i] = band[i, k]
    assert np.allclose(full, m[np.ix_(np.argsort(place), np.argsort(place))])


def test_bands_are_narrow():
    assert [reordered(CASES[x])[1].shape[1] - 1 for x in ("path", "ring", "grid")] == [1, 2, 6]


def test_repeated_and_zero_values():
    m = np.kron(np.eye(4), laplacian(3, [(0, 1), (1, 2), (2, 0)]))
    assert np.allclose(banded.lowest(reordered(m)[1], 6), [0, 0, 0, 0, 3, 3], atol=1e-10)
    assert banded.lowest(np.zeros((3, 1)), 5).round(9).tolist() == [0, 0, 0] and len(banded.lowest(np.zeros((0, 1)), 2)) == 0


def test_a_wide_band_is_refused(monkeypatch):
    monkeypatch.setattr(banded, "MOST_BAND", 20)
    with pytest.raises(ValueError, match="a band of 30"):
        reordered(CASES["path"])


def test_blocks(spark):
    rows = [(w, 3 * a, 3 * b) for w, seed in ((1, 5), (2, 6)) for a, b in np.random.default_rng(seed).integers(0, 12, (20, 2)).tolist()]
    coo = graph.laplacian(spark.createDataFrame(rows, "win long, src long, dst long"), loops="skip", multi="drop", by=["win"])
    got = banded.banded(coo, "win", 4).toPandas()
    for win in (1, 2):
        edges = [(a // 3, b // 3) for w, a, b in rows if w == win and a != b]
        used = sorted({x for e in edges for x in e})
        m = laplacian(len(used), [(used.index(a), used.index(b)) for a, b in edges])
        mine = got[got["win"] == win].sort_values("k")
        assert np.allclose(mine["eigenvalue"], np.linalg.eigvalsh(m)[:4], atol=1e-9)
        assert mine["before"].iloc[0] == max(abs(used.index(a) - used.index(b)) for a, b in edges) >= mine["after"].iloc[0] - 2
