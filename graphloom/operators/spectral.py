"""Spectra and entropy scores of blocks, one group of rows at a time.

A block is one window's or region's matrix. Its size is bounded by the window, not by the corpus, so a grouped pandas
function holds it; everything around it stays relational. Full spectra take a dense matrix; Lanczos' steps and random
probes only ever multiply the entries with vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import x_ln_x

#: Blocks above this order are solved for their smallest eigenvalues only.
FULL_ORDER, MOST_PAIRS, MOST_STEPS = 4096, 256, 512
#: Numbers in the vectors that Lanczos' steps keep of one block (1 GB); a larger block is refused.
MOST_KEPT = 1 << 27
EPS = 1e-9


class SpectrumError(ValueError):
    """A spectrum that the strict score refuses."""


def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a coordinate list and its matrix in their order."""
    nodes = np.unique(np.concatenate([pdf["row"].to_numpy(), pdf["col"].to_numpy()])) if len(pdf) else np.zeros(0, np.int64)
    m = np.zeros((len(nodes), len(nodes)))
    np.add.at(m, (np.searchsorted(nodes, pdf["row"]), np.searchsorted(nodes, pdf["col"])), pdf["value"].to_numpy(float))
    return nodes, m


class Entries:
    """A symmetric matrix as the entries of a coordinate list, in the order of its nodes."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        self.nodes = np.unique(np.concatenate([row, col]))
        by_row = np.argsort(row, kind="stable")
        self.row, self.col = np.searchsorted(self.nodes, row[by_row]), np.searchsorted(self.nodes, col[by_row])
        self.value = pdf["value"].to_numpy(float)[by_row]

    def __len__(self) -> int:
        return len(self.nodes)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 2:
            return np.column_stack([self @ x[:, k] for k in range(x.shape[1])])
        return np.bincount(self.row, self.value * x[self.col], len(self))

    def trace(self) -> float:
        return float(self.value[self.row == self.col].sum())

    def bound(self) -> float:
        """The largest absolute row sum, 1 at least: no eigenvalue is larger."""
        return max(1.0, float(np.bincount(self.row, np.abs(self.value), len(self)).max(initial=0.0)))


def full_spectrum(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues, and eigenvectors in columns, of a symmetric matrix."""
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise SpectrumError("a spectrum needs a square matrix")
    return np.linalg.eigh(m)


def lanczos(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, extra: int = 32, most: int = MOST_STEPS, tolerance: float = 1e-9, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs of a symmetric operator, with full reorthogonalization.

    At least k + extra steps are done, then ``extra`` at a time until the residuals of all k pairs are within the
    tolerance of the largest value, or ``most`` steps are done.
    """
    k = min(k, n)
    most = min(most, n)
    q = np.zeros((n, min(k + extra, most)))
    alpha, beta = np.zeros(most), np.zeros(most)
    rng = np.random.default_rng(seed)
    v = rng.standard_normal(n)
    v /= np.linalg.norm(v)
    for j in range(most):
        if j == q.shape[1]:
            q = np.hstack([q, np.zeros((n, min(extra, most - j)))])
        q[:, j] = v
        w = apply(v)
        alpha[j] = v @ w
        for _ in range(2):
            w = w - q[:, : j + 1] @ (q[:, : j + 1].T @ w)
        beta[j] = np.linalg.norm(w)
        if j + 1 == q.shape[1]:
            values, vectors = np.linalg.eigh(np.diag(alpha[: j + 1]) + np.diag(beta[:j], 1) + np.diag(beta[:j], -1))
            if j + 1 == most or (beta[j] * np.abs(vectors[-1, :k]) <= tolerance * max(1.0, np.abs(values).max())).all():
                break
        if beta[j] < 1e-12:  # an invariant subspace: go on in its complement
            w = rng.standard_normal(n)
            w = w - q[:, : j + 1] @ (q[:, : j + 1].T @ w)
            beta[j] = 0.0
        v = w / np.linalg.norm(w)
    return values[:k], q @ vectors[:, :k]


def smallest(pdf: pd.DataFrame, k: int, full: int = FULL_ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, the k smallest eigenvalues and their vectors in columns: exactly up to ``full`` nodes, by Lanczos beyond.

    A vector's entry of largest size is positive. Lanczos finds a repeated value once, until its space is used up.
    """
    m = Entries(pdf)
    if len(m) <= full:
        values, vectors = full_spectrum(dense(pdf)[1])
        values, vectors = values[:k], vectors[:, :k]
    else:
        k = min(k, MOST_PAIRS)
        most = min(MOST_STEPS, MOST_KEPT // len(m))
        if most < k + 32:
            raise SpectrumError(f"a block of {len(m)} nodes and {k} pairs; the bound is {MOST_KEPT} numbers")
        values, vectors = lanczos(lambda x: m @ x, len(m), k, most=most)
    top = np.abs(vectors).argmax(axis=0) if len(vectors) else np.zeros(0, int)
    return m.nodes, values, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


def chebyshev(f: Callable[[np.ndarray], np.ndarray], top: float, degree: int) -> np.ndarray:
    """Coefficients of f on [0, top] in Chebyshev polynomials, from its values at the Chebyshev nodes."""
    n = degree + 1
    theta = np.pi * (np.arange(n) + 0.5) / n
    values = f((np.cos(theta) + 1) * top / 2)
    c = 2 / n * (np.cos(np.outer(np.arange(n), theta)) @ values)
    c[0] /= 2
    return c


def entropy_score(values: np.ndarray, strict: bool = True) -> float:
    """Normalized entropy of a spectrum: -sum p ln p / ln m, p = value / sum.

    Strict: refuses values below -1e-9, a sum of 0 and fewer than two values. Lenient: leaves negative values out and
    scores a sum of 0 as 0.
    """
    if strict:
        if (values < -EPS).any() or len(values) < 2:
            raise SpectrumError("a spectrum needs two values or more, none negative")
        total = values.sum()
        if total <= 0:
            raise SpectrumError("a spectrum needs a positive sum")
    else:
        values = values[values >= -EPS] if len(values) else values
        total = values[values > 0].sum()
        if total == 0:
            return 0.0
        if len(values) == 1:
            return float("nan")
    p = values[values > 0] / total
    return float(-(p * np.log(p)).sum() / np.log(len(values)))


def hutchinson(apply: Callable[[np.ndarray], np.ndarray], n: int, trace: float, top: float, degree: int = 64, probes: int = 20, seed: int = 11) -> float:
    """The entropy score of an operator from random signs and a Chebyshev series of x ln x, never below 0."""
    if n <= 1 or trace <= 0:
        return 0.0
    c = chebyshev(lambda x: np.where(x > 1e-15, x * np.log(np.maximum(x, 1e-300)), 0.0), top, degree)
    z = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes))

    def scaled(x: np.ndarray) -> np.ndarray:
        return 2 / top * apply(x) - x

    a, b = z, scaled(z)
    total = c[0] * a + c[1] * b
    for k in range(2, degree + 1):
        a, b = b, 2 * scaled(b) - a
        total = total + c[k] * b
    estimate = float((z * total).sum() / probes)
    return max(0.0, (np.log(trace) - estimate / trace) / np.log(n))


def spectra(coo: DataFrame, by: str) -> DataFrame:
    """(by, k, eigenvalue) of each block, ascending."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values = full_spectrum(dense(pdf)[1])[0]
        return pd.DataFrame({by: pdf[by].iloc[0], "k": np.arange(len(values)), "eigenvalue": values})

    return coo.groupBy(by).applyInPandas(solve, f"{by} long, k long, eigenvalue double")


def block_scores(coo: DataFrame, by: str, exact: bool = True, degree: int = 64, probes: int = 20) -> DataFrame:
    """(by, nodes, score) of each block, from its spectrum or by random probes."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Entries(pdf)
        if exact:
            score = entropy_score(full_spectrum(dense(pdf)[1])[0], strict=False)
        else:
            score = hutchinson(lambda x: m @ x, len(m), m.trace(), m.bound(), degree, probes)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "nodes": [len(m)], "score": [score]})

    return coo.groupBy(by).applyInPandas(solve, f"{by} long, nodes long, score double")


def score_of_spectrum(spectrum: DataFrame, by: str, strict: bool = True) -> DataFrame:
    """(by, score) from a table of eigenvalues (by, eigenvalue), in SQL expressions; null where strict refuses."""
    value = F.col("eigenvalue")
    facts = spectrum.groupBy(by).agg(
        F.min("eigenvalue").alias("low"),
        F.sum(F.when(value >= -EPS, 1) if not strict else F.lit(1)).alias("m"),
        F.sum(F.when(value > 0, value).otherwise(0.0) if not strict else value).alias("total"),
        F.sum(x_ln_x(value)).alias("xlnx"),
    )
    # -sum (x/S) ln (x/S) = ln S - sum x ln x / S
    positive = F.col("total") > 0
    score = (F.log(F.when(positive, F.col("total"))) - F.col("xlnx") / F.when(positive, F.col("total"))) / F.log(F.when(F.col("m") > 1, F.col("m")))
    if strict:
        return facts.select(by, F.when((F.col("low") >= -EPS) & positive & (F.col("m") > 1), score).alias("score"))
    return facts.select(by, F.when(~positive, 0.0).when(F.col("m") <= 1, float("nan")).otherwise(score).alias("score"))


#: Nodes of the largest graph that is embedded as one dense block (200 MB).
MOST_NODES = 5_000


def embedding(coo: DataFrame, pairs: int = 6, zero: float = 1e-8) -> DataFrame:
    """(node, x, y): the two smallest non-zero eigenvectors of a normalized Laplacian over the root of their values.

    Signs are fixed so that the entry of largest size is positive. The matrix is one block of at most MOST_NODES rows;
    a larger graph is refused.
    """
    n = coo.select("row").distinct().count()
    if n > MOST_NODES:
        raise ValueError(f"an embedding of {n} nodes; the bound is {MOST_NODES}")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, m = dense(pdf)
        values, vectors = full_spectrum(m)
        values, vectors = values[:pairs], vectors[:, :pairs]
        axes = [vectors[:, k] / np.sqrt(values[k]) * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k]) for k in range(len(values)) if abs(values[k]) > zero][:2]
        axes += [np.zeros(len(nodes))] * (2 - len(axes))
        return pd.DataFrame({"node": nodes, "x": axes[0], "y": axes[1]})

    return coo.groupBy(F.lit(0).alias("__block")).applyInPandas(solve, "node long, x double, y double")


def chebyshev_table(spark: SparkSession, top: float, degree: int) -> DataFrame:
    """(k, coefficient) of x ln x on [0, top], as a double sum over ranges."""
    n = degree + 1
    nodes = spark.range(n).select(((F.col("id") + 0.5) * float(np.pi) / n).alias("theta")).withColumn("f", x_ln_x((F.cos("theta") + 1) * top / 2))
    # degree + 1 rows, met with as many
    terms = nodes.select("theta", "f", F.explode(F.sequence(F.lit(0), F.lit(degree))).alias("k"))
    return terms.groupBy("k").agg((F.sum(F.cos(F.col("k") * F.col("theta")) * F.col("f")) * F.min(F.when(F.col("k") == 0, 1.0 / n).otherwise(2.0 / n))).alias("coefficient"))
