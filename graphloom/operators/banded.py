"""Blocks of graphs brought to a narrow band, and their lowest eigenvalues from signs of pivots on the band.

A block is a window's or region's matrix, as in spectral, and is one group; blocks are worked on side by side. The
order is that of reverse breadth-first levels (Cuthill and McKee). On the band a shifted matrix is eliminated without
fill; the negative pivots count the eigenvalues below the shift, so bisection finds each by its number, repeated ones
as often as they occur, which Lanczos' steps do not tell. Work is the order times the square of the band.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .spectral import SpectrumError

#: Numbers of a block's band (200 MB), and the share of the largest value that a bisection comes down to.
MOST_BAND, TOLERANCE = 25_000_000, 1e-12


def levels(near: list[np.ndarray], start: int, degree: np.ndarray) -> list[list[int]]:
    """Nodes by their distance from start; within a level by the first neighbour before, then by degree and number."""
    seen, out, at = {start}, [], [start]
    while at:
        out.append(at)
        following: list[int] = []
        for node in at:
            new = [n for n in near[node].tolist() if n not in seen]
            new.sort(key=lambda n: (degree[n], n))
            seen.update(new)
            following += new
        at = following
    return out


def narrow_order(n: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The place of each of n nodes in the reversed order of levels, component by component.

    A component starts at an end of a long way through it: from a node of least degree to one of the last level, as
    long as that makes more levels.
    """
    apart = row != col
    row, col = row[apart], col[apart]
    by_row = np.argsort(row, kind="stable")
    near = np.split(col[by_row], np.cumsum(np.bincount(row, minlength=n))[:-1]) if n else []
    degree = np.array([len(x) for x in near])
    order: list[int] = []
    waiting = deque(np.argsort(degree, kind="stable").tolist())
    done = np.zeros(n, bool)
    while waiting:
        start = waiting.popleft()
        if done[start]:
            continue
        found = levels(near, start, degree)
        while True:
            far = levels(near, min(found[-1], key=lambda x: (degree[x], x)), degree)
            if len(far) <= len(found):
                break
            found = far
        order += [x for level in found for x in level]
        done[[x for level in found for x in level]] = True
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)[::-1]
    return place


def band_of(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The lower band of a symmetric matrix: entry (i + k, i) at [i, k]."""
    low = row >= col
    width = int((row - col).max(initial=0))
    if n * (width + 1) > MOST_BAND:
        raise SpectrumError(f"a band of {n} by {width + 1}; the bound is {MOST_BAND} numbers")
    band = np.zeros((n, width + 1))
    np.add.at(band, (col[low], (row - col)[low]), value[low])
    return band


def below(band: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift."""
    n, width = band.shape
    tiny = np.finfo(float).tiny ** 0.5
    window = np.zeros((len(shifts), width, width))  # what is left of the matrix in the rows that the next pivot meets
    for k in range(min(width, n)):
        for j in range(min(width - k, n - k)):
            window[:, k + j, k] = window[:, k, k + j] = band[k, j]
    diagonal = np.arange(min(width, n))
    window[:, diagonal, diagonal] -= shifts[:, None]
    count = np.zeros(len(shifts), np.int64)
    for i in range(n):
        pivot = window[:, 0, 0]
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
        first = window[:, 1:, 0]
        moved = np.zeros_like(window)
        moved[:, :-1, :-1] = window[:, 1:, 1:] - first[:, :, None] * (first / pivot[:, None])[:, None, :]
        new = i + width
        if new < n:
            entering = np.array([band[new - j, j] if j <= new else 0.0 for j in range(width - 1, -1, -1)])
            moved[:, -1, :] = entering
            moved[:, :, -1] = entering
            moved[:, -1, -1] -= shifts
        window = moved
    return count


def lowest(band: np.ndarray, k: int) -> np.ndarray:
    """The k smallest eigenvalues, all bisected side by side between the bounds that absolute row sums give."""
    n = len(band)
    k = min(k, n)
    sums = np.abs(band[:, 1:]).sum(axis=1)
    for j in range(1, band.shape[1]):
        sums[j:] += np.abs(band[: n - j, j])
    low, high = np.full(k, (band[:, 0] - sums).min(initial=0.0)), np.full(k, (band[:, 0] + sums).max(initial=0.0))
    scale = max(1.0, float(np.abs([low[:1], high[:1]]).max(initial=0.0)))
    # odd bounds, so that no middle is a round number: there a pivot may vanish, and digits with it
    low, high = low - 0.1 * (5**0.5 - 2) * scale, high + 0.1 * (2**0.5 - 1) * scale
    while k and (high - low).max() > TOLERANCE * scale:
        middle = (low + high) / 2
        less = below(band, middle) <= np.arange(k)
        low, high = np.where(less, middle, low), np.where(less, high, middle)
        if ((middle == low) | (middle == high)).all() and (high - low).max() <= 4 * np.finfo(float).eps * scale:
            break
    return (low + high) / 2


def banded(coo: DataFrame, by: str, k: int) -> DataFrame:
    """(by, nodes, before, after, k, eigenvalue) of each block of (by, row, col, value), symmetric: its bandwidth with the
    nodes in the order of their ids and in the narrow order, and its k smallest eigenvalues."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["row"].to_numpy(), pdf["col"].to_numpy()]))
        row, col = np.searchsorted(nodes, pdf["row"]), np.searchsorted(nodes, pdf["col"])
        place = narrow_order(len(nodes), row, col)
        band = band_of(len(nodes), place[row], place[col], pdf["value"].to_numpy(float))
        values = lowest(band, k)
        before = int(np.abs(row - col).max(initial=0))
        return pd.DataFrame({by: pdf[by].iloc[0], "nodes": len(nodes), "before": before, "after": band.shape[1] - 1, "k": np.arange(len(values)), "eigenvalue": values})

    return coo.groupBy(by).applyInPandas(solve, f"{by} long, nodes long, before long, after long, k long, eigenvalue double")
