"""Spectra of graphs beyond one task: vectors are columns of a table of nodes, a product is a join and a sum.

A space's matrix and vectors lie in slabs of places, in the same buckets, so a product exchanges what a slab of columns
adds to each slab of rows, and nothing else moves. A vector is written once, with its product. Only the coefficients of
the small problem, a few numbers for each step and slab, come to the driver. For probes, entries lie by column, vectors by node.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import bucketed, shared_dir, stored, with_rank
from .spectral import chebyshev

#: Steps after which a search that has not settled ends, and steps between two looks at the residuals.
MOST_STEPS, EVERY = 300, 8
#: What two vectors of a space may have in common, and the share of a product's square from which its rest is known.
COMMON, KNOWN = 1e-8, 1e-4


def _entries(coo: DataFrame) -> DataFrame:
    return bucketed(coo.select("row", F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")), "col")


def _nodes(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("col").alias("node")).union(entries.select("row")).distinct()


def _noise(seed: int) -> Column:
    """A number in (-1, 1) that follows from a node and a seed."""
    return F.xxhash64(F.lit(seed), "node").cast("double") / float(1 << 63)


#: Most places of a slab and, on average, most entries of its columns; fewer places are not worth a task.
SLAB, SLAB_ENTRIES, LEAST = 1 << 17, 1 << 22, 1 << 12
MATRIX = "slab long, rows binary, n binary, cols binary, most binary, odd binary, value binary, places binary"
VECTOR = "slab long, number long, x binary, w binary, dots binary"


def _numbers(cell: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def _rows(**named: list) -> pa.Table:
    kinds = {"slab": pa.int64(), "number": pa.int64(), "k": pa.int64()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in named.items()})


def _packed(width: int) -> Callable[[pa.Table], pa.Table]:
    """The entries of a slab of columns as one row, by rows: columns within the slab, the value in the middle of all,
    and where others stand."""

    def pack(t: pa.Table) -> pa.Table:
        slab, row, value = t["slab"][0].as_py(), t["row"].to_numpy(), t["value"].to_numpy()
        cols = (t["col"].to_numpy() - slab * width).astype(np.int32)
        order = np.argsort(row, kind="stable")
        row, cols, value = row[order], cols[order], value[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rows, n = row[start], np.diff(np.concatenate([start, [len(row)]]))
        most = np.partition(value, len(value) // 2)[len(value) // 2]
        odd = np.flatnonzero(value != most).astype(np.int32)
        found = {"rows": rows, "n": n.astype(np.int32), "cols": cols, "most": np.array([most]), "odd": odd, "value": value[odd], "places": np.flatnonzero(np.bincount(cols)).astype(np.int32)}
        return _rows(slab=[slab], **{c: [v.tobytes()] for c, v in found.items()})

    return pack


def _next(row: pa.RecordBatch | pa.Table, k: int, less: float, norm: float) -> np.ndarray:
    """The vector that follows x: w less a share of x, at length 1."""
    w = _numbers(row["w"][k])
    return (w - less * _numbers(row["x"][k])) / norm if less else w / norm


def _sums(width: int, less: float, norm: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the columns of a slab add to each slab of rows: all of its places, or those that are met."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda c, kind=np.float64: _numbers(batch[c][k], kind)  # noqa: B023, E731
                rows, n, cols, odd, most = of("rows", np.int64), of("n", np.int32), of("cols", np.int32), of("odd", np.int32), of("most")[0]
                x, ends = _next(batch, k, less, norm), np.cumsum(n)
                sums = np.add.reduceat(x[cols], ends - n) * most
                sums += np.bincount(np.searchsorted(ends, odd, "right"), (of("value") - most) * x[cols[odd]], len(rows))
                slabs, first = np.unique(rows // width, return_index=True)
                for slab, i, j in zip(slabs.tolist(), first, [*first[1:], len(rows)]):
                    places, part = (rows[i:j] - slab * width).astype(np.int32), sums[i:j]
                    if 3 * len(part) >= 2 * width:
                        whole = np.zeros(width)
                        whole[places] = part
                        places, part = places[:0], whole
                    yield from _rows(slab=[slab], places=[places.tobytes()], sums=[part.tobytes()]).to_batches()

    return product


def _met(width: int, number: int, less: float, norm: float, back: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The newest vector at a slab, its product less a share of the vector before, and their products."""

    def meet(parts: pa.Table, newest: pa.Table) -> pa.Table:
        x, w = _next(newest, 0, less, norm), np.zeros(width)
        for places, sums in zip(parts["places"], parts["sums"]):
            places, sums = _numbers(places, np.int32), _numbers(sums)
            if len(places):
                w[places] += sums
            else:
                w += sums
        if back:
            w -= back * _numbers(newest["x"][0])
        return _rows(slab=newest["slab"].to_pylist(), number=[number], x=[x.tobytes()], w=[w.tobytes()], dots=[np.array([x @ w, w @ w, x @ x]).tobytes()])

    return meet


def _cleared(less: float, shares: np.ndarray | None, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What follows x less its shares of the vectors at a slab, and what it has in common with them and itself then."""

    def clear(newest: pa.Table, space: pa.Table) -> pa.Table:
        w, numbers, dots = _next(newest, 0, less, 1.0).copy(), space["number"].to_pylist(), np.zeros(size + 1)
        if shares is not None:
            for number, x in zip(numbers, space["x"]):
                w -= shares[number] * _numbers(x)
        for number, x in zip(numbers, space["x"]):
            dots[number] = _numbers(x) @ w
        dots[-1] = w @ w
        kept = shares is not None
        return _rows(slab=newest["slab"].to_pylist(), number=[size], x=newest["x"].to_pylist() if kept else [b""], w=[w.tobytes() if kept else b""], dots=[dots.tobytes()])

    return clear


def _started(width: int) -> Callable[[pa.Table], pa.Table]:
    def start(t: pa.Table) -> pa.Table:
        slab = t["slab"][0].as_py()
        places, w = t["place"].to_numpy() - slab * width, np.zeros(width)
        w[places] = t["x"].to_numpy()
        return _rows(slab=[slab], nodes=[t["node"].to_numpy().astype(np.int64).tobytes()], places=[places.astype(np.int32).tobytes()], x=[b""], w=[w.tobytes()], dots=[np.array([w @ w, len(places)]).tobytes()])

    return start


def _combined(width: int, vectors: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """The vectors of the matrix at a slab from those of the space."""

    def combine(space: pa.Table) -> pa.Table:
        sums = np.zeros((vectors.shape[1], width))
        for number, x in zip(space["number"].to_pylist(), space["x"]):
            if number < len(vectors):
                q = _numbers(x)
                for k, factor in enumerate(vectors[number]):
                    sums[k] += factor * q
        return _rows(slab=[space["slab"][0].as_py()] * len(sums), k=list(range(len(sums))), entries=[v.tobytes() for v in sums])

    return combine


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            nodes, entries = _numbers(batch["nodes"][k], np.int64), _numbers(batch["entries"][k])[_numbers(batch["places"][k], np.int32)]
            yield pa.record_batch({"k": pa.array(np.full(len(nodes), batch["k"][k].as_py())), "node": pa.array(nodes), "entry": pa.array(entries)})


def _placed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.record_batch({"place": pa.array(_numbers(batch["places"][k], np.int32).astype(np.int64) + batch["slab"][k].as_py() * width)})

    return places


class Space:
    """A Krylov space of a symmetric matrix: a vector for each number, in slabs of its places.

    A node's place is its distance from the least node, or its rank where the nodes are few between their ends. A task
    adds up what a slab of columns gives before that is exchanged, so a matrix whose entries lie near its diagonal
    exchanges little more than a vector.

    A step reads the last two vectors and writes one, with its product, into a folder of its own. What a new vector has in
    common with those before it follows from the coefficients (Simon's recurrence); all vectors are read, and the new one
    and the next made orthogonal to them, where that passes COMMON, or where little is left of a product.
    """

    def __init__(self, coo: DataFrame, seed: int = 7) -> None:
        self.spark = spark = coo.sparkSession
        entries = stored(coo.select(*(F.col(c).cast("bigint").alias(c) for c in ("row", "col")), F.col("value").cast("double").alias("value")))
        low, high, count, diagonal = entries.agg(F.min(F.least("row", "col")), F.max(F.greatest("row", "col")), F.count("*"), F.count_if(F.col("row") == F.col("col"))).first()
        self.alpha, self.beta, self.closed, self.order = [], [], count == 0, 0
        if not count:
            return
        span, placed = high - low + 1, None
        if span > 4 * diagonal:  # fewer on the diagonal than nodes, or nodes far apart
            placed = stored(with_rank(_nodes(entries), "node", name="place"))
            n = placed.count()
            if span <= 4 * n:
                placed = None
            else:
                span = n
        for c in ("row", "col"):
            if placed is None:
                entries = entries.withColumn(c, F.col(c) - low)
            else:
                entries = entries.join(placed.select(F.col("node").alias(c), F.col("place").alias("__place")), c).withColumn(c, F.col("__place")).drop("__place")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        w = self.width = min(span, SLAB, max(LEAST, -(-span // (2 * self.parts))), max(LEAST, span * SLAB_ENTRIES // count))
        slab = lambda c: F.floor(F.col(c) / w).cast("bigint").alias("slab")
        self.matrix = bucketed(entries.select(slab("col"), "row", "col", "value").groupBy("slab").applyInArrow(_packed(w), MATRIX), "slab", parts=self.parts)
        if placed is None:
            placed = self.matrix.select("slab", "places").mapInArrow(_placed(w), "place long").withColumn("node", F.col("place") + low)
        self.base = bucketed(placed.select(slab("place"), "node", "place", _noise(seed).alias("x")).groupBy("slab").applyInArrow(_started(w), "slab long, nodes binary, places binary, x binary, w binary, dots binary"), "slab", parts=self.parts)
        self.path = f"{shared_dir(spark)}/space-{uuid.uuid4().hex}"
        square, n = self._total(self.base)
        self.order = int(n)
        self.newest, self.less, self.norm, self.back = self.base, 0.0, float(square**0.5) or 1.0, 0.0
        self.common, self.again, self.reads = [np.zeros(0), np.ones(1)], False, 0

    def _total(self, rows: DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(r["dots"]) for r in rows.select("dots").collect()], axis=0)

    def _written(self, rows: DataFrame, folder: str) -> DataFrame:
        name = f"space_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.path}/{folder}").bucketBy(self.parts, "slab").saveAsTable(name)
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only
        return found

    @property
    def rows(self) -> DataFrame:
        """(slab, number, x) of all vectors, in the buckets that each was written in."""
        name = f"space_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (slab BIGINT, number BIGINT, x BINARY) USING parquet OPTIONS (path '{self.path}/vectors', recursiveFileLookup 'true') CLUSTERED BY (slab) INTO {self.parts} BUCKETS")
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def step(self) -> None:
        """One product, made orthogonal to the vectors before."""
        k = len(self.alpha)
        newest = self.newest.select("slab", "x", "w")
        sums = self.matrix.drop("places").join(newest.hint("shuffle_hash"), "slab").mapInArrow(_sums(self.width, self.less, self.norm), "slab long, places binary, sums binary")
        met = sums.groupBy("slab").cogroup(newest.groupBy("slab")).applyInArrow(_met(self.width, k, self.less, self.norm, self.back), VECTOR)
        self.newest = self._written(met, f"vectors/{k}")
        dot, square, own = self._total(self.newest)
        self.alpha.append(dot / own)
        self.less, rest = self.alpha[k], square - 2 * self.alpha[k] * dot + self.alpha[k] ** 2 * own
        least = 1e-9 * max(1.0, max(map(abs, self.alpha)))
        known = rest > max(KNOWN * square, least**2)
        self.norm = float(np.sqrt(rest)) if known else least
        before, now = self.common
        after = self._in_common(before, now) if known else None
        if not known or self.again or np.abs(after[:-1]).max() > COMMON:
            self.again = not self.again and known
            after = self._clear(k, least)
        self.common = [now, after]
        self.beta.append(self.norm)
        self.back = self.norm
        if self.norm <= least or len(self.alpha) == self.order:
            self.closed = True  # what is left of the matrix does not meet this space

    def _in_common(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """What the next vector has in common with those before it, from what the last two had."""
        k = len(self.alpha) - 1
        a, b, error = np.array(self.alpha), np.array([*self.beta, self.norm]), np.finfo(float).eps * max(1.0, self.order**0.5)
        after = np.zeros(k + 2)
        inner = b[:k] * now[1:] + (a[:k] - a[k]) * now[:k]
        inner[1:] += b[: max(k - 1, 0)] * now[: max(k - 1, 0)]
        inner -= (b[k - 1] if k else 0.0) * before[:k]
        after[:k] = (inner + np.sign(inner) * error * (np.abs(a).max() + b.max())) / self.norm
        after[k], after[k + 1] = error * max(1.0, np.abs(a).max() / self.norm), 1.0
        return after

    def _clear(self, k: int, least: float) -> np.ndarray:
        """The newest product less what it has in common with all vectors, until nothing of it is left."""
        space, size = self.rows, k + 1
        self.reads += 1

        def cleared(newest: DataFrame, less: float, shares: np.ndarray | None) -> DataFrame:
            return newest.select("slab", "x", "w").groupBy("slab").cogroup(space.groupBy("slab")).applyInArrow(_cleared(less, shares, size), VECTOR)

        *shares, square = self._total(cleared(self.newest, self.less, None))
        first, less = shares[k], self.less
        for turn in range(3):
            self.newest = self._written(cleared(self.newest, less, np.array(shares)), f"cleared/{k}-{turn}")
            less = self.less = 0.0
            *shares, square = self._total(self.newest)
            self.norm = float(np.sqrt(max(0.0, square - np.dot(shares, shares))))
            if self.norm <= least or np.abs(shares).max() <= 1e-12 * self.norm:
                break
        self.alpha[k] += first
        return np.append(np.maximum(np.abs(shares) / max(self.norm, least), np.finfo(float).eps * max(1.0, self.order**0.5)), 1.0)

    def ritz(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending values, their residuals, and their vectors within the space, in columns."""
        m = len(self.alpha)
        if not m:
            return np.zeros(0), np.zeros(0), np.zeros((0, 0))
        off = np.diag(self.beta[: m - 1], 1)
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + off + off.T)
        return values, (0.0 if self.closed else self.beta[-1]) * np.abs(vectors[-1]), vectors

    def combined(self, vectors: np.ndarray) -> DataFrame:
        """(k, node, entry) of combinations of the space, in columns."""
        mixed = self.rows.groupBy("slab").applyInArrow(_combined(self.width, vectors), "slab long, k long, entries binary")
        return mixed.join(self.base.select("slab", "nodes", "places").hint("shuffle_hash"), "slab").mapInArrow(_unpacked, "k long, node long, entry double")


def lowest(coo: DataFrame, k: int, most: int = MOST_STEPS, tolerance: float = 1e-9, every: int = EVERY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(k, eigenvalue, residual) and (k, node, entry) of the k smallest eigenpairs of a symmetric matrix.

    Steps are done until the residuals are within the tolerance of the largest value, or ``most`` are done; the residual
    tells. A repeated value is found once, with one vector. A vector's length is 1; its sign is open.
    """
    space = Space(coo, seed)
    while not space.closed and len(space.alpha) < most:
        space.step()
        if space.closed or len(space.alpha) % every == 0:
            values, residuals, _ = space.ritz()
            if len(values) >= k and (residuals[:k] <= tolerance * max(1.0, np.abs(values).max())).all():
                break
    values, residuals, vectors = space.ritz()
    k = min(k, len(values))
    spark = coo.sparkSession
    found = spark.createDataFrame([(j, float(values[j]), float(residuals[j])) for j in range(k)], "k long, eigenvalue double, residual double")
    if not k:
        return found, spark.createDataFrame([], "k long, node long, entry double")
    return found, space.combined(vectors[:, :k])


def probe_score(coo: DataFrame, degree: int = 64, probes: int = 24, seed: int = 11) -> DataFrame:
    """(nodes, score): the entropy score from random signs and a Chebyshev series of x ln x, as spectral.hutchinson.

    Signs follow from node, probe and seed. Each of degree / 2 rounds is one product for all probes: the product of two
    neighbouring terms of the series with each other gives the moments of twice the degree.
    """
    from .graph import trace_and_bound

    entries = _entries(coo)
    spark = coo.sparkSession
    facts = trace_and_bound(coo).first()
    n = _nodes(entries).count()
    trace, top = (float(facts["trace"] or 0), float(facts["bound"])) if facts else (0.0, 1.0)
    if n <= 1 or trace <= 0:
        return spark.createDataFrame([(n, 0.0)], "nodes long, score double")
    c = chebyshev(lambda x: np.where(x > 1e-15, x * np.log(np.maximum(x, 1e-300)), 0.0), top, degree)
    signs = F.array(*(F.when(F.xxhash64(F.lit(seed), F.lit(p), "node") % 2 == 0, 1.0).otherwise(-1.0) for p in range(probes)))

    def scaled(rows: DataFrame, of: str) -> DataFrame:
        """rows with y = 2 / top M v - v for each vector v of the array."""
        moved = entries.join(rows.select(F.col("node").alias("col"), F.col(of).alias("v")), "col")
        sums = moved.groupBy(F.col("row").alias("node")).agg(*(F.sum(F.col("value") * F.get("v", F.lit(p))).alias(f"s{p}") for p in range(probes)))
        met = rows.join(sums.select("node", F.array(*(f"s{p}" for p in range(probes))).alias("s")), "node", "left")
        none = F.array(*(F.lit(0.0) for _ in range(probes)))
        return met.withColumn("y", F.zip_with(F.coalesce("s", none), F.col(of), lambda s, v: s * (2 / top) - v)).drop("s")

    def dot(a: str, b: str) -> Column:
        return F.sum(F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))

    rows = bucketed(_nodes(entries).select("node", signs.alias("a")), "node")
    rows = bucketed(scaled(rows, "a").select("node", "a", F.col("y").alias("b")), "node")  # T_0 z and T_1 z
    moments = np.zeros(degree + 2)
    moments[0], moments[1] = rows.agg(dot("a", "a"), dot("a", "b")).first()[:]
    for k in range(1, degree // 2 + 1):  # a and b hold the terms k - 1 and k
        even, = rows.agg(dot("b", "b")).first()[:]
        moments[2 * k] = 2 * even - moments[0]
        if 2 * k < degree:
            rows = bucketed(scaled(rows, "b").select("node", F.col("b").alias("a"), F.zip_with("y", "a", lambda y, a: 2 * y - a).alias("b")), "node")
            odd, = rows.agg(dot("a", "b")).first()[:]
            moments[2 * k + 1] = 2 * odd - moments[1]
    estimate = float(c @ moments[: degree + 1]) / probes
    return spark.createDataFrame([(n, max(0.0, float((np.log(trace) - estimate / trace) / np.log(n))))], "nodes long, score double")
