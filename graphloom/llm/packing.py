"""Packing documents into windows of 2048 tokens by non-negative least squares.

A document's whole windows stand alone; what is packed is its tail of under 2048 tokens, so the corpus comes down to
a histogram of at most 2047 tail lengths. Shallow combinations of lengths that fill a window exactly are enumerated
(pairs, one length repeated with a filler, triples of frequent lengths), their repeat counts are solved against the
histogram by non-negative least squares, rounded down to what is there, and topped up greedily. The tails left over
are laid end to end and cut at window edges; the last, shorter stretch is cut into powers of two. So nothing is
padded. Only the histogram and the plan (a few thousand rows, whatever the corpus) pass through the driver: a tail
finds its place from its length and its rank among tails of that length, and ranks come from counts per partition.

Cases: a null or empty text has the end token alone; a text of a whole number of windows has no tail; a very long text
is cut into windows as it is read, in one worker that holds its ids; tails of one length are taken in the order of the
scan; repeated rows and null ids are packed row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import encode

WINDOW = 2048
END = 1
#: Lengths whose triples are enumerated, and the most repeats of one length in a combination.
FREQUENT, REPEATS = 64, 16
#: The solver stops where a whole sweep moves the repeats by less than this share of all tails, or after SWEEPS; what
#: it has left over then is packed as any other rest, so the stop costs no tail its place.
MOVED, SWEEPS = 1e-4, 400
#: Cut tails up to this number are broadcast by row id (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Sequence ids of whole windows: partition + 1 above this bit, so that they never meet those of the plan.
PART_BIT = 36

#: Document ids travel as text through pandas, which would turn whole numbers beside a null into doubles.
CUTS = "row long, id string, tokens long, part long, whole_from long, tail long, at long, crcs array<long>, tail_ids binary"
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _tokenizing(folder: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, whole, seen = TaskContext.get().partitionId(), 0, np.zeros(WINDOW, np.int64)
        for pdf in batches:
            rows = []
            for row, doc, text in zip(pdf["row"], pdf["id"], pdf["text"]):
                ids = np.append(encode(text, folder), np.uint32(END))
                tail = len(ids) % WINDOW
                crcs = [_crc(ids[k : k + WINDOW]) for k in range(0, len(ids), WINDOW)]
                rest = ids[len(ids) - tail :]
                rows.append((row, doc, len(ids), part, whole, tail, seen[tail], crcs, rest.astype("<u4").tobytes()))
                whole += len(ids) // WINDOW
                seen[tail] += 1
            yield _frame(rows, CUTS)

    return run


def combinations(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of present lengths, each filling a window exactly."""
    there = np.flatnonzero(hist).tolist()
    found: set[tuple[int, ...]] = set()
    for a in there:
        for k in range(1, REPEATS + 1):
            b = WINDOW - k * a
            if b == 0 and k > 1:
                found.add((a,) * k)
            elif b > 0 and hist[b]:
                found.add(tuple(sorted((a,) * k + (b,))))
    top = sorted(sorted(there, key=lambda x: (-hist[x], x))[:FREQUENT])
    for i, a in enumerate(top):
        for b in top[i:]:
            if WINDOW - a - b >= b and hist[WINDOW - a - b]:
                found.add((a, b, WINDOW - a - b))
    return sorted(found)


def least_squares(hist: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """x >= 0 that brings the lengths used nearest to hist, by cyclic coordinate descent."""
    columns = [np.unique(c, return_counts=True) for c in combos]
    norms = [float((n * n).sum()) for _, n in columns]
    x, left, enough = np.zeros(len(combos)), hist.astype(float), MOVED * max(1.0, float(hist.sum()))
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (at, n) in enumerate(columns):
            step = max(-x[j], float(n @ left[at]) / norms[j])
            if step:
                x[j] += step
                left[at] -= step * n
                moved += abs(step)
        if moved < enough:
            break
    return x


def plan(hist: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """Slots (length, first rank, end rank, first sequence, offset), tails used by length, sequences used."""
    combos = combinations(hist)
    x = least_squares(hist, combos)
    left = hist.astype(np.int64).copy()
    times = np.zeros(len(combos), np.int64)
    parts = [np.unique(c, return_counts=True) for c in combos]
    order = np.argsort(-x, kind="stable")
    for wanted in (np.floor(x), np.full(len(combos), np.inf)):  # rounded down; then topped up greedily
        for j in order:
            at, n = parts[j]
            take = int(min(wanted[j], (left[at] // n).min()))
            times[j] += take
            left[at] -= take * n
    used, slots, sequence = np.zeros(WINDOW, np.int64), [], 0
    for j in np.flatnonzero(times):
        offset, count = 0, int(times[j])
        for length in combos[j]:
            slots.append((length, int(used[length]), int(used[length]) + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return slots, used, sequence


def edges_of(total: int, first: int) -> tuple[int, list[tuple[int, int]]]:
    """The stream's whole windows, and (start, sequence) of the power-of-two stretches behind them."""
    full, at, ends = total // WINDOW, total // WINDOW * WINDOW, []
    for bit in range(WINDOW.bit_length() - 1, -1, -1):
        if (total - at) >> bit & 1:
            ends.append((at, first + full + len(ends)))
            at += 1 << bit
    return full, ends


class Placement:
    """Where each tail goes: arrays of the plan, small enough to travel with the tasks."""

    def __init__(self, hist: np.ndarray) -> None:
        slots, self.used, self.first = plan(hist)
        slots.sort()
        self.length, self.start, self.end, self.sequence, self.offset = (np.array([s[k] for s in slots], np.int64) for k in range(5))
        self.key = (self.length << 44) + self.start
        over = (hist - self.used) * np.arange(WINDOW)
        self.base = np.concatenate([[0], np.cumsum(over)[:-1]])
        self.total = int(over.sum())
        self.full, self.ends = edges_of(self.total, self.first)
        self.starts = np.array([a for a, _ in self.ends], np.int64)

    def slot(self, tail: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a tail has a slot of the plan, and its sequence and offset there."""
        if not len(self.key):
            return np.zeros(len(tail), bool), tail, tail
        k = np.maximum(np.searchsorted(self.key, (tail << 44) + rank, "right") - 1, 0)
        return rank < self.used[tail], self.sequence[k] + rank - self.start[k], self.offset[k]

    def stretch(self, position: int) -> tuple[int, int, int]:
        """(sequence, start, end) of the stretch of the left-over stream that holds a position."""
        if position < self.full * WINDOW:
            k = position // WINDOW
            return self.first + k, k * WINDOW, (k + 1) * WINDOW
        k = int(np.searchsorted(self.starts, position, "right")) - 1
        end = self.ends[k + 1][0] if k + 1 < len(self.ends) else self.total
        return self.ends[k][1], self.ends[k][0], end

    def cuts(self, tail: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) of the pieces of a left-over tail."""
        position, out, at = int(self.base[tail] + (rank - self.used[tail]) * tail), [], 0
        while at < tail:
            sequence, start, end = self.stretch(position + at)
            to = min(tail, end - position)
            out.append((at, to, sequence, position + at - start))
            at = to
        return out


def _placing(place: Placement, cut_ones: bool):
    """The pieces of each row; those of a cut tail only where cut_ones, and then only those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            tail, rank = pdf["tail"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            slotted, sequence, offset = place.slot(tail, rank)
            tails = pdf["tail_ids"] if cut_ones else [None] * len(pdf)
            for k, (doc, tokens, part, whole, crcs, tail_ids) in enumerate(zip(pdf["id"], pdf["tokens"], pdf["part"], pdf["whole_from"], pdf["crcs"], tails)):
                n = tokens // WINDOW
                if not cut_ones:
                    rows += [(doc, j * WINDOW, WINDOW, crcs[j], tokens, ((part + 1) << PART_BIT) + whole + j, 0) for j in range(n)]
                if not tail[k]:
                    continue
                if slotted[k]:
                    pieces = [(0, int(tail[k]), int(sequence[k]), int(offset[k]))]
                else:
                    pieces = place.cuts(int(tail[k]), int(rank[k]))
                if cut_ones:
                    back = np.frombuffer(tail_ids, "<u4")
                    rows += [(doc, n * WINDOW + a, b - a, _crc(back[a:b]), tokens, s, o) for a, b, s, o in pieces]
                elif len(pieces) == 1:
                    rows.append((doc, n * WINDOW, int(tail[k]), crcs[n], tokens, pieces[0][2], pieces[0][3]))
            yield _frame(rows, PIECES)

    return run


def _cut_flag(place: Placement):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tail, rank = pdf["tail"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            slotted = place.slot(tail, rank)[0]
            yield pdf[[bool(t) and not s and len(place.cuts(int(t), int(r))) > 1 for t, r, s in zip(tail, rank, slotted)]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    cut = written(source.mapInPandas(_tokenizing(folder), CUTS))
    counts = cut.groupBy("tail", "part").count()
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("tail", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    hist = np.zeros(WINDOW, np.int64)
    for r in counts.groupBy("tail").agg(F.sum("count").alias("n")).collect():
        hist[r["tail"]] = r["n"] if r["tail"] else 0
    place = Placement(hist)
    ranked = cut.drop("tail_ids").join(base, ["tail", "part"]).withColumn("rank", F.col("at") + F.col("base")).drop("base", "at")
    whole = ranked.mapInPandas(_placing(place, False), PIECES)
    slim = ranked.select("row", "tail", "rank").where("tail > 0").mapInPandas(_cut_flag(place), "row long, tail long, rank long")
    straddlers = slim.select("row", "rank")
    if place.full + len(place.ends) <= BROADCAST_ROWS:
        straddlers = F.broadcast(straddlers)
    pieces = cut.join(straddlers, "row").mapInPandas(_placing(place, True), PIECES)
    return whole.unionByName(pieces).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
