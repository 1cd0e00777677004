"""Best-fit packing of whole documents into sequences of 4096 tokens by a grouping genetic algorithm.

Documents of more than a sequence are cut into whole sequences and a rest; all other pieces stay whole. Pieces are
dealt at random into problems of about PROBLEM pieces. Each problem is worked on by ISLANDS islands, each a row with a
population of groupings, in EPOCHS epochs; between two epochs the best grouping of each island moves to the next one
(a join on problem and island). A crossover takes whole well-filled bins of one parent into the other, takes the bins
that hold one of their documents apart, and puts what is displaced where it fits best. Of the islands of a problem the
best grouping counts, and of that the well-filled bins; the documents of its other bins are dealt out again with those
of all problems, until they are one problem. So every round packs the rest of the round before, at most three quarters
of it, and no problem or island grows with the corpus. Only counts pass through the driver.

Ids are those of ``tokenizers``. No token spans white space, so each lot of texts is cut at white space and every
distinct stretch is encoded once; ids are then laid out by array. Stretches of ASCII and Latin letters, which are
normalized as they stand, go through ``tiktoken`` over the same vocabulary in a quarter of the time (tests hold one
against the other); all others, and those that may spell a special token, go to ``tokenizers`` itself.

Cases: a null or empty text has the end token alone; a text of a whole number of sequences leaves one piece with the
end token; a very long text is cut in one worker that holds its ids; repeated rows and null ids are packed row by row;
pieces of equal length are told apart by the number of their row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, written
from .splits import kinds, lots, words
from .tokens import vocab_path

WINDOW, END = 4096, 1
KIND = kinds(b" \t\n\x0b\x0c\r")
#: Stretches of text that a worker remembers with their ids, and how many new ones are encoded at a time.
REMEMBERED, ENCODED = 200_000, 10_000
#: Pieces of a problem, islands of a problem, groupings of an island, epochs, and generations of an epoch.
PROBLEM, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2048, 3, 4, 2, 30
#: A bin counts as well filled from this share on, and at least a quarter of a problem's bins are kept.
FILLED = 0.998
END_BYTES = np.array([END], "<u4").tobytes()

STATE = "problem long, island int, pieces binary, lengths binary, groups binary, elite binary, bins int, fitness double"


@functools.cache
def encoder(folder: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_path("word_bpe_49k.json", folder))


#: Stands for the end of a word, in stretches that do not hold it.
MARK = "\x7f"
#: Latin letters without combining signs: lower case takes each to one other, and nothing is composed.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: What a stretch may hold to be split here: ASCII, those letters, and common quotes and dashes.
PLAIN = re.compile(rf"[\x00-\x7e{LATIN}\u00ab\u00bb\u2013\u2014\u2018-\u201e\u2026]*")
#: The split of word_bpe_49k (fixed value) for such stretches in lower case, one a line.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\na-z{LATIN}0-9]+")


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write bytes as signs: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def fast_encoder(folder: str | None = None):
    """Lines of marked words to ids; a line's end is the id of a line feed, which no stretch holds."""
    import tiktoken

    byte, ranks = _byte_of_sign(), {}
    for token, id_ in encoder(folder).get_vocab(with_added_tokens=False).items():
        word = token.removesuffix("</w>")
        ranks[bytes(byte[c] for c in word) + (MARK.encode() if word != token else b"")] = id_
    return tiktoken.Encoding("word_bpe_49k", pat_str=rf"[^{MARK}\n]+{MARK}|\n", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


class Ids:
    """Ids of stretches of text without white space, each distinct one encoded once in a while."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder, self.known = folder, {}

    def of(self, stretches: list[str]) -> list[list[int]]:
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, stretches
        plain, other = [], []
        for s in new:
            (plain if PLAIN.fullmatch(s) and "<|" not in s else other).append(s)
        for k in range(0, len(plain), ENCODED):
            some = plain[k : k + ENCODED]
            fast, end = fast_encoder(self.folder)
            ids = fast.encode_ordinary(SPLIT.sub(rf"\g<0>{MARK}", "".join(s + "\n" for s in some).lower()))
            at = 0
            for s in some:
                to = ids.index(end, at)
                self.known[s] = ids[at:to]
                at = to + 1
        for k in range(0, len(other), ENCODED):
            some = other[k : k + ENCODED]
            self.known.update(zip(some, (e.ids for e in encoder(self.folder).encode_batch(some, add_special_tokens=False))))
        return [self.known[s] for s in stretches]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after another, and where each text begins and ends."""
        text, _, word = words(texts, KIND)
        coded = word.dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self.of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        begin, n = (np.cumsum(sizes) - sizes)[of], sizes[of]
        ends = np.cumsum(n)
        place = np.arange(int(n.sum())) + np.repeat(begin - (ends - n), n)
        edges = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(texts) + 1))]
        return flat[place].astype("<u4"), edges


def _pieces(folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(folder)
        for batch in batches:
            for a, b in lots(batch.column("text")):
                some = batch.slice(a, b - a)
                flat, edges = ids.texts(some.column("text"))
                of, piece, start, length, crc = [], [], [], [], []
                for k in range(len(some)):
                    mine = flat[edges[k] : edges[k + 1]]
                    for p, s in enumerate(range(0, len(mine) + 1, WINDOW)):
                        part = mine[s : s + WINDOW]
                        sum_ = zlib.crc32(part.tobytes())
                        last = len(part) < WINDOW
                        of.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part) + last)
                        crc.append(zlib.crc32(END_BYTES, sum_) if last else sum_)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


class Grouping:
    """Which bin each document of a problem is in; bins are numbered from 0 and none is empty."""

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray) -> None:
        _, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.fill = np.bincount(self.bin_of, weights=lengths).astype(np.int64)
        #: Few bins first; of equally many, uneven ones, since an emptier bin is nearer to being dissolved.
        self.fitness = float(((self.fill / WINDOW) ** 2).sum()) / max(1, len(self.fill)) - len(self.fill)


def best_fit(lengths: np.ndarray, bin_of: np.ndarray, displaced: np.ndarray) -> np.ndarray:
    """Puts displaced documents, in their order, into the fullest bin with room; into a new bin where there is none."""
    bin_of = bin_of.copy()
    bin_of[displaced] = -1
    inside = bin_of >= 0
    fill = np.bincount(bin_of[inside], weights=lengths[inside]).astype(np.int64)
    bits = 32
    room = sorted((WINDOW - f) << bits | b for b, f in enumerate(fill.tolist()) if 0 < f < WINDOW)
    new = len(fill)
    for k, n in zip(displaced.tolist(), lengths[displaced].tolist()):
        at = bisect_left(room, n << bits)
        if at < len(room):
            entry = room.pop(at)
            b, left = entry & ((1 << bits) - 1), (entry >> bits) - n
        else:
            b, left = new, WINDOW - n
            new += 1
        bin_of[k] = b
        if left:
            insort(room, left << bits | b)
    return bin_of


def crossover(lengths: np.ndarray, taker: Grouping, giver: Grouping, rng: np.random.Generator) -> np.ndarray:
    """taker with some well-filled bins of giver, whole; their documents leave taker's bins, which are taken apart."""
    order = np.argsort(-giver.fill, kind="stable")
    rich = order[: max(1, len(order) // 2)]
    given = np.zeros(len(giver.fill), bool)
    given[rng.choice(rich, max(1, len(rich) // 2), replace=False)] = True
    moved = given[giver.bin_of]
    hit = np.zeros(len(taker.fill), bool)
    hit[taker.bin_of[moved]] = True
    bin_of = np.where(moved, len(taker.fill) + giver.bin_of, taker.bin_of)
    displaced = np.flatnonzero(hit[taker.bin_of] & ~moved)
    return best_fit(lengths, bin_of, displaced[np.argsort(-lengths[displaced], kind="stable")])


def shaken(lengths: np.ndarray, one: Grouping, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and a few others taken apart, and their documents put where they fit best."""
    n = len(one.fill)
    apart = np.zeros(n, bool)
    apart[np.argsort(one.fill, kind="stable")[: 1 + n // 50]] = True
    apart[rng.integers(0, n, 1 + n // 20)] = True
    displaced = np.flatnonzero(apart[one.bin_of])
    noise = lengths[displaced] * rng.uniform(0.9, 1.1, len(displaced))
    return best_fit(lengths, one.bin_of, displaced[np.argsort(-noise, kind="stable")])


def founders(lengths: np.ndarray, rng: np.random.Generator) -> list[Grouping]:
    """Best fit in falling order, and in orders that are nearly so."""
    nobody = np.full(len(lengths), -1)
    orders = [np.argsort(-lengths * (rng.uniform(0.7, 1.3, len(lengths)) if k else 1.0), kind="stable") for k in range(POPULATION)]
    return [Grouping(lengths, best_fit(lengths, nobody, order)) for order in orders]


def done(one: Grouping) -> bool:
    """No grouping has fewer bins, and all but one are well filled."""
    return len(one.fill) == -(-int(one.fill.sum()) // WINDOW) and int((one.fill < FILLED * WINDOW).sum()) <= 1


def evolved(lengths: np.ndarray, people: list[Grouping], rng: np.random.Generator) -> list[Grouping]:
    """POPULATION groupings, the best first, after GENERATIONS of one child each."""
    people = sorted(people, key=lambda g: -g.fitness)[:POPULATION]
    for _ in range(GENERATIONS):
        if done(people[0]):
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = Grouping(lengths, crossover(lengths, people[a], people[b], rng))
        child = Grouping(lengths, shaken(lengths, child, rng))
        people = sorted([*people, child], key=lambda g: -g.fitness)[:POPULATION]
    return people


def _epoch(seed: int):
    """One epoch of every island; a guest, where there is one, takes the place of the island's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i2").astype(np.int64)
                rng = np.random.default_rng([seed, r["problem"], r["island"]])
                if r["groups"] is None:
                    people = founders(lengths, rng)
                else:
                    people = [Grouping(lengths, g) for g in np.frombuffer(r["groups"], "<i2").reshape(-1, len(lengths))]
                    people[-1:] = [Grouping(lengths, np.frombuffer(r["guest"], "<i2"))]
                people = evolved(lengths, people, rng)
                groups = b"".join(g.bin_of.astype("<i2").tobytes() for g in people)
                best = people[0]
                rows.append({**r, "groups": groups, "elite": best.bin_of.astype("<i2").tobytes(), "bins": len(best.fill), "fitness": best.fitness})
            names = [c.split()[0] for c in STATE.split(", ")]
            kinds_ = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds_[f.split()[1]]) for c, f in zip(names, STATE.split(", "))], names=names)

    return run


def _problem(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("row")
    return pa.table(
        {
            "problem": rows.column("problem")[:1],
            "pieces": pa.array([rows.column("row").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "lengths": pa.array([rows.column("length").to_numpy().astype("<i2").tobytes()], pa.binary()),
        }
    )


def _placed(final: bool):
    """(row, length, bin, offset) of the winners' documents; bin is null for those that are dealt out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pieces, lengths = np.frombuffer(r["pieces"], "<i8"), np.frombuffer(r["lengths"], "<i2").astype(np.int64)
                best = Grouping(lengths, np.frombuffer(r["elite"], "<i2"))
                kept = np.full(len(best.fill), final)
                kept[best.fill >= FILLED * WINDOW] = True
                kept[np.argsort(-best.fill, kind="stable")[: (len(best.fill) + 3) // 4]] = True
                order = np.argsort(best.bin_of, kind="stable")
                bins, sizes = best.bin_of[order], lengths[order]
                ends = np.cumsum(sizes)
                begins = np.concatenate([[0], np.cumsum(best.fill)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pieces[order]),
                        pa.array(sizes),
                        pa.array(np.full(len(bins), r["problem"])),
                        pa.array(bins, pa.int64(), mask=~kept[bins]),
                        pa.array(ends - sizes - begins[bins]),
                    ],
                    names=["row", "length", "problem", "bin", "offset"],
                )

    return run


def groupings(pieces: DataFrame) -> DataFrame:
    """(row, sequence_id, offset) of pieces(row, length), each shorter than a sequence; sequences are numbered from 0."""
    left, out, round_ = cut(pieces.select("row", "length")), [], 0
    while True:
        n = left.count()
        problems = max(1, -(-n // PROBLEM))
        dealt = left.withColumn("problem", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(problems)))
        state = dealt.groupBy("problem").applyInArrow(_problem, "problem long, pieces binary, lengths binary")
        state = state.select("problem", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island"), "pieces", "lengths", F.lit(None).cast("binary").alias("groups"), F.lit(None).cast("binary").alias("guest"))
        for epoch in range(EPOCHS):
            if epoch:
                guests = state.select("problem", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
                state = state.join(guests, ["problem", "island"])
            state = cut(state.mapInArrow(_epoch(round_ * EPOCHS + epoch), STATE))
        best = state.groupBy("problem").agg(F.max_by(F.struct("pieces", "lengths", "elite"), F.struct("fitness", "island")).alias("best")).select("problem", "best.*")
        placed = written(best.mapInArrow(_placed(problems == 1), "row long, length long, problem long, bin long, offset long"))
        name = (F.lit(round_) * (1 << 56)) + F.col("problem") * (1 << 16) + F.col("bin")
        out.append(placed.where("bin is not null").select("row", name.alias("sequence_id"), "offset"))
        if problems == 1:
            return functools.reduce(DataFrame.union, out)
        left, round_ = placed.where("bin is null").select("row", "length"), round_ + 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    pieces = written(texts.mapInArrow(_pieces(folder), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long").withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == WINDOW).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).drop("row")
    short = pieces.where(F.col("length") < WINDOW)
    return whole.unionByName(short.join(groupings(short), "row").drop("row"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
