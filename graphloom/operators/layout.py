"""Layout of a graph by forces: nodes push each other away, edges pull, and moves grow smaller from step to step.

The push of all nodes on all others is summed over a tree of square cells, never over pairs of all nodes. Cells of more
than ``most`` nodes are divided, down to ``depth`` halvings of the square around all nodes. What a node feels comes from
the largest cells that lie beyond ``reach`` cells of their own size from its own cell, each as one mass at its centre,
and from the single nodes of small cells nearer by. Which cells act on which follows from their numbers alone, and a cell
has a bounded list of what acts on it. Crowds within a cell of the last level count as one mass.

Nodes have places, kept in slabs, and each step deals them to tiles: the largest cells of a bounded number of nodes. A
tile finds its own cells and sends to each tile around what acts there, cells as masses and few nodes as they are; so a
step exchanges a node's place a few times and no lists of cells by node. Cells above the tiles are few and go to all
tasks. Edges lie in blocks with the nodes they meet; a step sends a block the places of these once.

Edges that share both ends pull as often as they are there; loops do not. Nodes without edges are pushed only, edges
with an unknown end are left out, and so are nodes without a name or a place. Nodes in one place do not push each other.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import bucketed, kept, stored, with_rank

ITERATIONS, HEAT, SOFT = 50, 0.1, 1e-6
MOST, REACH, DEPTH = 32, 2, 20
#: Most nodes of a tile, most and least places of a slab, edges of a block, and pairs of nodes looked at at once.
TILE, SLAB, LEAST, BLOCK, PAIRS = 1 << 15, 1 << 17, 1 << 12, 1 << 20, 1 << 20
#: Bits of a cell's number along one side, in keys of both.
SIDE_BITS = 21
SLABS = "slab long, x binary, y binary, facts binary"
FORCES = "slab long, places binary, fx binary, fy binary"
DEALT = "tile long, slab long, places binary, x binary, y binary, cells binary, lists binary"


def scattered(nodes: DataFrame, seed: int = 1) -> DataFrame:
    """(node, x, y): a place in the unit square for each of nodes(node), by hash."""
    place = lambda k: F.xxhash64("node", F.lit(seed), F.lit(k)).cast("double") / float(1 << 64) + 0.5
    return nodes.select("node", place(0).alias("x"), place(1).alias("y"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _of(cell: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def _joined(cells: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind)


def _rows(**named: list) -> pa.Table:
    kinds = {"slab": pa.int64(), "tile": pa.int64(), "block": pa.int64()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in named.items()})


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of n numbers from start on, one after another."""
    ahead = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - ahead, n)


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2 ** 21 at every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << shift) & mask
    return v


def _gathered(v: np.ndarray) -> np.ndarray:
    v = v & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | v >> shift) & mask
    return v


def _cell(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    """One number for a cell of a level: that of its parent is that number over 4."""
    return _spread(ix) | _spread(iy) << 1


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start, and how long they are."""
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(of)]]))


class Slabs(NamedTuple):
    """Places of n nodes in slabs of so many numbers, not a number where there is no node."""

    rows: DataFrame
    width: int
    n: int


class Square(NamedTuple):
    x0: float
    y0: float
    side: float

    def cells(self, x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
        """The cells of a level. Halvings are exact, so they lie within those above."""
        number = lambda c, low: np.floor((c - low) / self.side * 2.0**level).astype(np.int64)
        return _cell(number(x, self.x0), number(y, self.y0))


class Nodes(NamedTuple):
    slabs: Slabs
    square: Square


def _facts(x: np.ndarray, y: np.ndarray) -> bytes:
    here = ~np.isnan(x)
    x, y = x[here], y[here]
    return np.array([x.min(), y.min(), x.max(), y.max()] if len(x) else [np.inf, np.inf, -np.inf, -np.inf]).tobytes()


def _known(nodes: DataFrame) -> DataFrame:
    """The nodes with a name and a place."""
    x, y = (F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in ("x", "y"))
    return kept(nodes.select("node", x, y).dropna())


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int, int | None]:
    """nodes with numbers from 0 on, how many numbers there are, and the node of number 0: a node's number is its
    distance from the least one, or its rank, with no such node, where nodes are few between their ends or not numbers."""
    low, high, n = nodes.agg(F.min("node"), F.max("node"), F.count("*")).first()
    if n and isinstance(low, int) and high - low + 1 <= 4 * n:
        return nodes.withColumn("at", (F.col("node") - F.lit(low)).cast("bigint")), high - low + 1, low
    return stored(with_rank(nodes, "node", name="at")), n, None


def _in_slabs(numbered: DataFrame, span: int, n: int) -> Slabs:
    width = max(1, min(span, SLAB, max(LEAST, -(-span // (2 * _parts(numbered))))))

    def pack(t: pa.Table) -> pa.Table:
        slab = t["slab"][0].as_py()
        at, x, y = t["at"].to_numpy() - slab * width, np.full(width, np.nan), np.full(width, np.nan)
        x[at], y[at] = t["x"].to_numpy(), t["y"].to_numpy()
        return _rows(slab=[slab], x=[x.tobytes()], y=[y.tobytes()], facts=[_facts(x, y)])

    slab = F.floor(F.col("at") / width).cast("bigint").alias("slab")
    return Slabs(stored(numbered.select(slab, "at", "x", "y").groupBy("slab").applyInArrow(pack, SLABS)), width, n)


def _out_of(slabs: DataFrame, width: int, numbered: DataFrame, low: int | None, *columns: str) -> DataFrame:
    """(node, columns) from rows(slab, columns) with a number for each place of a slab."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = [_of(batch[c][k]) for c in columns]
                at = np.flatnonzero(~np.isnan(values[0]))
                yield pa.record_batch({"at": pa.array(at + batch["slab"][k].as_py() * width), **{c: pa.array(v[at]) for c, v in zip(columns, values)}})

    found = slabs.select("slab", *columns).mapInArrow(unpack, ", ".join(("at long", *(f"{c} double" for c in columns))))
    if low is None:
        return found.join(numbered.select("node", "at"), "at").select("node", *columns)
    return found.select((F.col("at") + low).cast(dict(numbered.dtypes)["node"]).alias("node"), *columns)


def _around(slabs: Slabs) -> Nodes:
    """Nodes with the square around all of them."""
    x0, y0, x1, y1 = np.array([np.frombuffer(r["facts"]) for r in slabs.rows.select("facts").collect()]).T
    side = max(x1.max() - x0.min(), y1.max() - y0.min(), 1e-12) * 1.001
    return Nodes(slabs, Square(float(x0.min()), float(y0.min()), float(side)))


def _in_cells(nodes: Nodes, depth: int) -> DataFrame:
    """(cell, n, x, y): the cells of a level, how many nodes they hold, and the sums of their places."""
    square = nodes.square

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = _of(batch["x"][k]), _of(batch["y"][k])
                x, y = x[~np.isnan(x)], y[~np.isnan(x)]
                cells, at, n = np.unique(square.cells(x, y, depth), return_inverse=True, return_counts=True)
                yield pa.record_batch({"cell": cells, "n": n, "x": np.bincount(at, x, len(cells)), "y": np.bincount(at, y, len(cells))})

    found = nodes.slabs.rows.select("x", "y").mapInArrow(count, "cell long, n long, x double, y double")
    return found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y")))


class Tiles(NamedTuple):
    """Disjoint cells that hold all nodes, as ranges of cells of the last level, in their order; a crowd in a cell of the
    last level makes several. ``above``: the cells that hold more than one, and such crowds, as rows of _cells."""

    start: np.ndarray
    end: np.ndarray
    level: np.ndarray
    share: np.ndarray
    shares: np.ndarray
    above: np.ndarray
    depth: int

    def of(self, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tile of each node, from its cell of the last level and its number."""
        tile = np.searchsorted(self.end, cells, "right")
        return tile + at % self.shares[tile]

    def over(self, level: np.ndarray, ix: np.ndarray, iy: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the cell, tile) for all tiles that have part in the cells within reach of cells of any levels."""
        reached = np.arange(-reach, reach + 1)
        bx, by = ix[:, None, None] + reached[:, None], iy[:, None, None] + reached
        inside = (bx >= 0) & (by >= 0) & (np.maximum(bx, by) < (1 << level)[:, None, None])
        which, *_ = np.nonzero(inside)
        bx, by = np.broadcast_arrays(bx, by)
        cells, below = _cell(bx[inside], by[inside]), 2 * (self.depth - level[which])
        first, last = np.searchsorted(self.end, cells << below, "right"), np.searchsorted(self.start, (cells + 1) << below, "left")
        n = np.maximum(last - first, 0)
        pairs = np.unique(np.repeat(which, n) * len(self.start) + _ranges(first, n))
        return pairs // len(self.start), pairs % len(self.start)


def _cells(level: int | np.ndarray, cell: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of level, ix, iy, n and centre, from sums of places."""
    return np.column_stack([np.broadcast_to(level, cell.shape), _gathered(cell), _gathered(cell >> 1), n, x / n, y / n]).astype(float)


def _tiles(nodes: Nodes, most: int, depth: int) -> Tiles:
    """Cells are counted on a level where they hold few nodes on average, and those with more on levels below it."""
    n = nodes.slabs.n
    cap = max(4 * most, min(TILE, -(-n // (2 * _parts(nodes.slabs.rows)))))
    level = min(depth, 1 + math.ceil(math.log(n / cap, 4))) if n > cap else 0
    counted, found = _in_cells(nodes, level), []
    while True:
        cell, *sums = (np.array(v) for v in list(zip(*counted.collect())))
        found.append((np.full(len(cell), level), cell, *sums))
        crowded = cell[sums[0] > cap]
        if level == depth or not len(crowded):
            break
        found[-1] = tuple(v[sums[0] <= cap] for v in found[-1])
        below = min(3, depth - level)
        level += below
        counted = _in_cells(nodes, level).where(F.shiftright("cell", 2 * below).isin(crowded.tolist()))
    at, cell, *sums = (np.concatenate(v) for v in zip(*found))
    tiles, above = [], []
    for level in range(depth + 1):
        cells, of = np.unique(cell >> 2 * (at - level), return_inverse=True)
        n, x, y = (np.bincount(of, v, len(cells)) for v in sums)
        many = n > cap
        above.append(_cells(level, cells[many], n[many], x[many], y[many]))
        if level == depth:
            tiles.append((np.full(len(cells), level), cells, n))
            break
        tiles.append((np.full((~many).sum(), level), cells[~many], n[~many]))
        at, cell, *sums = (v[many[of]] for v in (at, cell, *sums))
        if not len(cell):
            break
    level, cell, n = (np.concatenate(v) for v in zip(*tiles))
    start, end = cell << 2 * (depth - level), (cell + 1) << 2 * (depth - level)
    order = np.argsort(start)
    shares = np.where((level == depth) & (n > cap), np.ceil(n / cap), 1).astype(np.int64)[order]
    again = np.repeat(order, shares)
    return Tiles(start[again], end[again], level[again], _ranges(np.zeros_like(shares), shares), np.repeat(shares, shares), np.concatenate(above), depth)


def _dealt(nodes: Nodes, tiles: Tiles) -> DataFrame:
    """The nodes of each slab in each tile."""
    square, width = nodes.square, nodes.slabs.width

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                slab, x, y = batch["slab"][k].as_py(), _of(batch["x"][k]), _of(batch["y"][k])
                at = np.flatnonzero(~np.isnan(x))
                tile = tiles.of(square.cells(x[at], y[at], tiles.depth), at + slab * width)
                order = np.argsort(tile, kind="stable")
                at, tile = at[order], tile[order]
                start, n = _runs(tile)
                pieces = [at[i : i + m] for i, m in zip(start, n)]
                yield from _rows(tile=tile[start].tolist(), slab=[slab] * len(pieces), places=[p.astype(np.int32).tobytes() for p in pieces], x=[x[p].tobytes() for p in pieces], y=[y[p].tobytes() for p in pieces], cells=[None] * len(pieces), lists=[None] * len(pieces)).to_batches()

    return nodes.slabs.rows.select("slab", "x", "y").mapInArrow(deal, DEALT)


def _sent(square: Square, tiles: Tiles, most: int, reach: int) -> Callable[[pa.Table], pa.Table]:
    """A tile's nodes as they came, and for each tile what of its cells acts there."""

    def send(t: pa.Table) -> pa.Table:
        tile = t["tile"][0].as_py()
        if tiles.shares[tile] > 1:
            return t  # a crowd in a cell of the last level; it is among the cells above
        x, y = _joined(t["x"]), _joined(t["y"])
        code = square.cells(x, y, tiles.depth)
        order = np.argsort(code, kind="stable")
        x, y, code = x[order], y[order], code[order]
        cells, lists, singles = [], [], []
        for level in range(tiles.level[tile], tiles.depth + 1):  # of all nodes here, those in cells whose parents are divided
            cell = code >> 2 * (tiles.depth - level)
            start, n = _runs(cell)
            found = _cells(level, cell[start], n, np.add.reduceat(x, start), np.add.reduceat(y, start))
            few = n <= most
            cells.append(found)
            lists.append(found[few, :4])
            alone = np.repeat(few, n)
            singles.append(np.column_stack([x[alone], y[alone]]))
            x, y, code = x[~alone], y[~alone], code[~alone]
            if not len(x):
                break
        cells, lists, singles = np.concatenate(cells), np.concatenate(lists), np.concatenate(singles)

        def over(rows: np.ndarray, up: int) -> dict[int, np.ndarray]:
            """The rows for each tile near them, or near their parents."""
            level, ix, iy = rows[:, :3].astype(np.int64).T
            level, ix, iy = np.maximum(level - up, 0), ix >> up, iy >> up
            below = np.maximum(level - tiles.level[tile], 0)
            within = level >= tiles.level[tile]
            for c in (ix, iy):
                within &= (c - reach) >> below == (c + reach) >> below
            rest = np.flatnonzero(~within)
            which, to = tiles.over(level[rest], ix[rest], iy[rest], reach)
            which, to = np.concatenate([np.flatnonzero(within), rest[which]]), np.concatenate([np.full(within.sum(), tile), to])
            order = np.lexsort([which, to])
            which, to = which[order], to[order]
            start, n = _runs(to)
            return {to[i]: which[i : i + m] for i, m in zip(start, n)}

        far, near = over(cells, 1), over(lists, 0)
        n = lists[:, 3].astype(np.int64)
        first, out = np.cumsum(n) - n, {"tile": [], "x": [], "y": [], "cells": [], "lists": []}
        for to in sorted({*far, *near}):
            which = near.get(to, np.zeros(0, np.int64))
            alone = singles[_ranges(first[which], n[which])]
            for c, v in zip(out, (None, alone[:, 0], alone[:, 1], cells[far.get(to, which[:0])], lists[which])):
                out[c].append(int(to) if v is None else v.tobytes())
        rest = {"slab": [-1] * len(out["tile"]), "places": [None] * len(out["tile"])}
        return pa.concat_tables([t, _rows(**out, **rest).select(t.column_names).cast(t.schema)])

    return send


def _felt(square: Square, tiles: Tiles, strength: float, most: int, reach: int) -> Callable[[pa.Table], pa.Table]:
    """The push on each node of a tile, from what was sent there and from the cells above the tiles."""
    high, depth = tiles.above, tiles.depth

    def feel(t: pa.Table) -> pa.Table:
        of_node = pc.greater_equal(t["slab"], 0)
        own, sent = t.filter(of_node), t.filter(pc.invert(of_node))
        x, y = _joined(own["x"]), _joined(own["y"])
        code = square.cells(x, y, depth)
        order = np.argsort(code, kind="stable")
        x, y, code = x[order], y[order], code[order]
        fx, fy = np.zeros(len(x)), np.zeros(len(x))
        cells = np.concatenate([_joined(sent["cells"]).reshape(-1, 6), high])
        lists = _joined(sent["lists"]).reshape(-1, 4)
        singles = np.column_stack([_joined(sent["x"]), _joined(sent["y"])])
        size = lists[:, 3].astype(np.int64)
        first = np.cumsum(size) - size

        def keyed(rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
            """The keys of the rows of a level, in order, and which rows these are."""
            which = np.flatnonzero(rows[:, 0] == level)
            key = (rows[which, 1].astype(np.int64) << SIDE_BITS) + rows[which, 2].astype(np.int64)
            order = np.argsort(key, kind="stable")
            return key[order], which[order]

        def met(keys: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether cells are there, and where; a number beyond the square is no other cell's key."""
            key = (bx << SIDE_BITS) + by
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return keys[at] == key, at

        for level in np.unique(cells[:, 0]).astype(int).tolist():
            cell = code >> 2 * (depth - level)
            start, n = _runs(cell)
            ax, ay = _gathered(cell[start]), _gathered(cell[start] >> 1)
            at_nodes = lambda v: v[0] if len(v) == 1 else np.repeat(v, n)  # noqa: B023, E731
            keys, rows = keyed(cells, level)
            w, mx, my = cells[rows, 3:].T
            for ox in range(-2 * reach, 2 * reach + 2):
                for oy in range(-2 * reach, 2 * reach + 2):
                    bx, by = (ax & -2) + ox, (ay & -2) + oy
                    there, at = met(keys, bx, by)
                    there &= (np.maximum(np.abs(bx - ax), np.abs(by - ay)) > reach) | ((w[at] > most) & (level == depth))
                    if there.any():
                        dx, dy = x - at_nodes(mx[at]), y - at_nodes(my[at])
                        q = at_nodes(np.where(there, w[at], 0.0)) / (dx * dx + dy * dy + SOFT)
                        fx += dx * q
                        fy += dy * q
            keys, rows = keyed(lists, level)
            if not len(keys):
                continue
            near = range(-reach, reach + 1)
            hits = [(there, rows[at]) for there, at in (met(keys, ax + ox, ay + oy) for ox in near for oy in near)]
            a = np.concatenate([np.flatnonzero(there) for there, _ in hits])
            b = np.concatenate([row[there] for there, row in hits])
            node, b = _ranges(start[a], n[a]), np.repeat(b, n[a])
            ends = np.cumsum(size[b])
            cuts = np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) + PAIRS, PAIRS) if len(ends) else [])
            for i, j in zip([0, *cuts], [*cuts, len(node)]):
                if i == j:
                    continue
                of, m = node[i:j], size[b[i:j]]
                one = singles[_ranges(first[b[i:j]], m)]
                dx, dy = np.repeat(x[of], m) - one[:, 0], np.repeat(y[of], m) - one[:, 1]
                q = 1 / (dx * dx + dy * dy + SOFT)
                begin = np.cumsum(m) - m
                fx += np.bincount(of, np.add.reduceat(dx * q, begin), len(x))
                fy += np.bincount(of, np.add.reduceat(dy * q, begin), len(x))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        fx, fy = strength * fx[back], strength * fy[back]
        cuts = np.cumsum([len(v) // 4 for v in own["places"].to_pylist()])[:-1]
        return pa.table({"slab": own["slab"], "places": own["places"], "fx": pa.array([v.tobytes() for v in np.split(fx, cuts)], pa.binary()), "fy": pa.array([v.tobytes() for v in np.split(fy, cuts)], pa.binary())})

    return feel


def _pushes(nodes: Nodes, strength: float, most: int, reach: int, depth: int) -> DataFrame:
    """(slab, places, fx, fy): the push on nodes, in as many rows as tiles hold nodes of a slab."""
    parts, tiles = _parts(nodes.slabs.rows), _tiles(nodes, most, depth)
    sent = _dealt(nodes, tiles).repartition(parts, "tile").groupBy("tile").applyInArrow(_sent(nodes.square, tiles, most, reach), DEALT)
    return sent.repartition(parts, "tile").groupBy("tile").applyInArrow(_felt(nodes.square, tiles, strength, most, reach), FORCES)


def _totals(width: int, parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fx, fy = np.zeros(width), np.zeros(width)
    for at, px, py in zip(parts["places"], parts["fx"], parts["fy"]):
        at = _of(at, np.int32)
        fx[at] += _of(px)
        fy[at] += _of(py)
    return fx, fy


def repulsion(nodes: DataFrame, strength: float, most: int = MOST, reach: int = REACH, depth: int = DEPTH) -> DataFrame:
    """(node, fx, fy): the sum over all other nodes(node, x, y) of strength / distance, away from them."""
    nodes = _known(nodes)
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    numbered, span, low = _numbered(nodes)
    slabs = _in_slabs(numbered, span, n)
    width = slabs.width

    def add(rows: pa.Table, parts: pa.Table) -> pa.Table:
        fx, fy = _totals(width, parts)
        fx[np.isnan(_of(rows["x"][0]))] = np.nan
        return _rows(slab=[rows["slab"][0].as_py()], fx=[fx.tobytes()], fy=[fy.tobytes()])

    pushes = _pushes(_around(slabs), strength, most, reach, depth)
    felt = slabs.rows.groupBy("slab").cogroup(pushes.groupBy("slab")).applyInArrow(add, "slab long, fx binary, fy binary")
    return _out_of(felt, width, numbered, low, "fx", "fy")


def _in_blocks(edges: DataFrame, numbered: DataFrame, span: int, low: int | None, width: int) -> tuple[DataFrame, DataFrame]:
    """(block, nodes, a, b, n): edges(src, dst) as numbers into a block's list of nodes, and how often they are there; and
    (slab, block, places): which places of a slab a block asks for."""
    used = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    for c in ("src", "dst"):
        if low is None:
            used = used.join(numbered.select(F.col("node").alias(c), F.col("at").alias("__at")), c).withColumn(c, F.col("__at")).drop("__at")
        else:
            used = used.withColumn(c, (F.col(c) - F.lit(low)).cast("bigint")).where(F.col(c).between(0, span - 1))
    if low is None:
        used = stored(used)
    parts = _parts(edges)
    dealt = used.repartitionByRange(max(parts, -(-used.count() // BLOCK)), "dst", "src").select("src", "dst", F.spark_partition_id().cast("bigint").alias("part"))

    def block(part: int, number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = (np.concatenate([batch[c].to_numpy() for batch in batches]) for c in ("src", "dst"))
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        pairs, n = np.unique(at[len(src) :] * len(nodes) + at[: len(src)], return_counts=True)
        a, b, n = ((pairs % len(nodes)).astype(np.int32), (pairs // len(nodes)).astype(np.int32), n.astype(np.int32))
        return _rows(block=[(part << 24) + number], nodes=[nodes.tobytes()], a=[a.tobytes()], b=[b.tobytes()], n=[b"" if (n == 1).all() else n.tobytes()]).to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * BLOCK:
                yield block(held[0]["part"][0].as_py(), number, held)
                held, rows, number = [], 0, number + 1
        if held:
            yield block(held[0]["part"][0].as_py(), number, held)

    blocks = bucketed(dealt.mapInArrow(pack, "block long, nodes binary, a binary, b binary, n binary"), "block", parts=parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                slabs, pieces = _by_slab(_of(batch["nodes"][k], np.int64), width)
                yield from _rows(slab=slabs, block=[batch["block"][k].as_py()] * len(slabs), places=pieces).to_batches()

    asked = blocks.select("block", "nodes").mapInArrow(ask, "slab long, block long, places binary")
    return blocks, bucketed(asked, "slab", parts=parts)


def _by_slab(nodes: np.ndarray, width: int) -> tuple[list[int], list[bytes]]:
    """The slabs of ascending numbers, and the places of each."""
    start, n = _runs(nodes // width)
    slabs = (nodes[start] // width).tolist()
    return slabs, [(nodes[i : i + m] - slab * width).astype(np.int32).tobytes() for slab, i, m in zip(slabs, start, n)]


def _pulls(slabs: Slabs, blocks: DataFrame, asked: DataFrame, ideal: float) -> DataFrame:
    """(slab, places, fx, fy): the sum over edges of n * distance ** 2 / ideal, towards the other end."""
    width = slabs.width

    def answer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        slab, places = asks["slab"].to_pylist(), [_of(p, np.int32) for p in asks["places"]]
        x, y = (_of(rows[c][0]) for c in ("x", "y")) if rows.num_rows else (np.full(width, np.nan),) * 2
        return _rows(block=asks["block"].to_pylist(), slab=slab, x=[x[p].tobytes() for p in places], y=[y[p].tobytes() for p in places])

    def pull(edges: pa.Table, places: pa.Table) -> pa.Table:
        places = places.sort_by("slab")
        nodes, x, y = _of(edges["nodes"][0], np.int64), _joined(places["x"]), _joined(places["y"])
        a, b, n = (_of(edges[c][0], np.int32) for c in ("a", "b", "n"))
        dx, dy = x[b] - x[a], y[b] - y[a]
        pull = np.sqrt(dx * dx + dy * dy + SOFT) / ideal * (n if len(n) else 1)
        pull[np.isnan(dx)] = 0  # an end that is no node
        sums = [np.bincount(a, v, len(nodes)) - np.bincount(b, v, len(nodes)) for v in (np.nan_to_num(dx) * pull, np.nan_to_num(dy) * pull)]
        slab, at = _by_slab(nodes, width)
        cuts = np.cumsum([len(p) // 4 for p in at])[:-1]
        fx, fy = ([v.tobytes() for v in np.split(s, cuts)] for s in sums)
        return _rows(slab=slab, places=at, fx=fx, fy=fy)

    told = slabs.rows.select("slab", "x", "y").groupBy("slab").cogroup(asked.groupBy("slab")).applyInArrow(answer, "block long, slab long, x binary, y binary")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(pull, FORCES)


def laid_out(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, heat: float = HEAT, **tree: int) -> DataFrame:
    """(node, x, y) of nodes(node, x, y), one row a node, after so many steps under edges(src, dst).

    A step moves a node along its force, by at most ``heat`` times the share of steps that is left. Each step is cut
    into the shared folder.
    """
    now = _known(nodes)
    n = now.count()
    if n < 2:
        return now
    ideal = (1.0 / n) ** 0.5
    tree = {"most": MOST, "reach": REACH, "depth": DEPTH} | tree
    numbered, span, low = _numbered(now)
    slabs = _in_slabs(numbered, span, n)
    width = slabs.width
    blocks, asked = _in_blocks(edges, numbered, span, low, width)

    def moved(most: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def move(rows: pa.Table, parts: pa.Table) -> pa.Table:
            x, y = _of(rows["x"][0]), _of(rows["y"][0])
            fx, fy = _totals(width, parts)
            size = np.sqrt(fx * fx + fy * fy + SOFT)
            share = np.minimum(size, most) / size
            x, y = x + fx * share, y + fy * share
            return _rows(slab=[rows["slab"][0].as_py()], x=[x.tobytes()], y=[y.tobytes()], facts=[_facts(x, y)])

        return move

    for step in range(iterations):
        forces = _pushes(_around(slabs), ideal * ideal, **tree).unionByName(_pulls(slabs, blocks, asked, ideal))
        rows = slabs.rows.groupBy("slab").cogroup(forces.groupBy("slab")).applyInArrow(moved(heat * (1 - step / iterations)), SLABS)
        slabs = slabs._replace(rows=stored(rows))
    return _out_of(slabs.rows, width, numbered, low, "x", "y")
