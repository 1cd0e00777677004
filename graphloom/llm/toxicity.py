"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled documents (``examples``, chosen by a hash of the id) and every word of
them. A term's weight in a text is (1 + ln tf) * idf * relevance, with document frequencies counted over all documents
and relevance the root of the term's chi-square against the label. Without the relevance, on texts of mostly rare
words, the nearest examples share a rare word by chance and most toxic documents are missed (figures in the README).
A word that no example has, or that is independent of the label, has chi-square 0: its weight is 0, so it adds nothing
to a norm either.

Every document is scored. Terms of many examples have dense posting lists, which are summed for a batch of documents
as one product of matrices. Of the others, the terms that can add most are summed over all examples first. What the rest
can add to any example is bounded by the largest products, to an example of a block of examples by the largest
products in that block, and by the norm; every example that may still be among the k nearest is then summed in full, so that the
k nearest are exact. Votes weighted by similarity are calibrated by a logistic curve fitted to leave-one-out votes of
the examples. A document's own label is no evidence: an example of its id is left out. The nearest examples and their
similarities are returned as evidence.

Cases: a null or empty text, and one without any term of the index, gets the share of toxic ones among the examples
that have none either; a very long text is counted whole; without labels of both kinds every score is that of the
prior; repeated labels of an id count once, by their largest, and of rows that repeat an id the least text is the
example; null labels and null ids are not learned from; ties in similarity go to the smaller example id; repeated rows
are scored row by row; an empty table gives no rows; other columns are ignored, and carried by ``drop_toxic``.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table, without, written

#: Labelled documents in the index: the documented bound of what is fitted and broadcast.
EXAMPLES = 4_096
NEAREST = 15
#: Terms are summed over all examples until the others can add no more than this to a cosine.
TAIL = 0.15
#: Examples in one block of the index.
BLOCK = 128
#: Documents scored in one task, and examples.
SCORED, CALIBRATED = 8_192, 512
#: Rows that a worker hands back at a time.
SLICE = 1_024
#: A term has a dense posting list if one of so many examples has it; so many documents are scored together.
DENSE, BATCH = 16, 64
#: The vote for the prior, as so much similarity.
PRIOR = 0.1

WORD = re.compile(r"[^\W_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample_labels(labels: DataFrame, examples: int) -> DataFrame:
    """(id, toxic): at most about ``examples`` learnable rows, those of the smallest id hashes."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut(usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = examples / max(1, known.count())
    return known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))


def _term_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            (pos if toxic else neg).update(word_counts(text).keys())
        both = pos.keys() | neg.keys()
        yield pd.DataFrame([(w, pos[w], neg[w]) for w in both], columns=["term", "pos", "neg"])


def relevant_terms(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Every term of texts(text, toxic) whose chi-square against the label is not 0, and its root."""
    n = texts.groupBy("toxic").count().collect()
    n1, n0 = (float(sum(r["count"] for r in n if (r["toxic"] or 0) == k)) for k in (1, 0))
    counts = texts.mapInPandas(_term_labels, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    a, b, c, d = F.col("a"), F.col("b"), F.lit(n1) - F.col("a"), F.lit(n0) - F.col("b")
    below = (a + b) * (c + d) * F.lit(n1) * F.lit(n0)
    chi2 = F.when(below > 0, F.lit(n1 + n0) * F.pow(a * d - b * c, 2) / below).otherwise(0.0)
    found = counts.select("term", chi2.alias("chi2")).where("chi2 > 0").toArrow().to_pandas().sort_values("term")
    return found["term"].tolist(), np.sqrt(found["chi2"].to_numpy(float))


def _counting(shared):
    """The terms and counts of each text, beside all other columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {t: k for k, t in enumerate(zlib.decompress(shared.value).decode().split("\n"))}
        for pdf in batches:
            # in slices: the terms of a whole batch as lists would outweigh its texts
            for part in (pdf[k : k + SLICE] for k in range(0, len(pdf), SLICE)):
                at, tf = [], []
                for text in part["text"]:
                    found = np.array([(number[w], n) for w, n in word_counts(text).items() if w in number], np.int32).reshape(-1, 2)
                    found = found[found[:, 0].argsort()]
                    at.append(found[:, 0])
                    tf.append(found[:, 1])
                yield part.drop(columns="text").assign(terms=at, counts=tf)

    return run


@dataclass
class Index:
    """Examples by their terms; postings by term; the largest weight of each term, in all and in each block."""

    weight: np.ndarray  # of a term: idf * relevance
    ids: list[str] = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0
    curve: tuple[float, float] | None = None

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.weight[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm else w

    def build(self, examples: list[tuple[str, int, list[int], list[int]]]) -> Index:
        """examples: (id, toxic, terms, counts), in the order of ids."""
        blank = [e[1] for e in examples if not len(e[2])]
        everything = [e[1] for e in examples]
        self.base = (sum(everything) + 1) / (len(everything) + 2) if everything else 0.0
        self.prior = (sum(blank) + self.base) / (len(blank) + 1) if everything else 0.0
        kept = [e for e in examples if len(e[2])]
        self.ids, self.toxic = [str(e[0]) for e in kept], np.array([e[1] for e in kept], float)
        self.row_start = np.concatenate([[0], np.cumsum([len(e[2]) for e in kept], dtype=np.int64)])
        self.row_term = np.concatenate([np.asarray(e[2], np.int32) for e in kept]) if kept else np.zeros(0, np.int32)
        self.row_count = np.concatenate([np.asarray(e[3], np.int32) for e in kept]) if kept else np.zeros(0, np.int32)
        return self._posted()

    def _posted(self) -> Index:
        """What follows from the examples' terms and counts."""
        sizes = np.diff(self.row_start)
        w = (1 + np.log(self.row_count)) * self.weight[self.row_term]
        norm = np.sqrt(np.add.reduceat(w * w, self.row_start[:-1])) if len(sizes) else np.zeros(0)
        self.row_value = w / np.repeat(np.where(norm > 0, norm, 1.0), sizes)
        order = np.argsort(self.row_term, kind="stable")
        example, term = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], self.row_term[order]
        value = self.row_value[order]
        often = np.flatnonzero(np.bincount(term, minlength=len(self.weight)) * DENSE > len(sizes))
        self.dense_of = np.full(len(self.weight), -1, np.int32)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(sizes)))
        long = self.dense_of[term] >= 0
        self.dense[self.dense_of[term[long]], example[long]] = value[long]
        self.example, self.value, term = example[~long], value[~long], term[~long]
        self.start = np.searchsorted(term, np.arange(len(self.weight) + 1))
        self.place = {i: k for k, i in enumerate(self.ids)}
        # within a term postings are in the order of examples, so those of a block adjoin
        self.blocks = -(-len(self.ids) // BLOCK)
        of_block = term.astype(np.int64) * self.blocks + self.example // BLOCK
        heads = np.flatnonzero(np.diff(of_block, prepend=-1))
        self.block = (of_block[heads] % max(1, self.blocks)).astype(np.int32)
        self.block_value = np.maximum.reduceat(self.value, heads) if len(heads) else np.zeros(0)
        self.block_start = np.searchsorted(heads, self.start)
        self.largest = np.zeros(len(self.weight))
        np.maximum.at(self.largest, term, self.value)
        self.query = np.zeros(len(self.weight))
        return self

    def __getstate__(self) -> bytes:
        """Terms and counts only, compressed: every executor keeps a copy."""
        derived = ("row_value", "example", "value", "start", "largest", "query", "place", "dense_of", "dense", "blocks", "block", "block_value", "block_start")
        return zlib.compress(pickle.dumps({k: v for k, v in self.__dict__.items() if k not in derived}, protocol=5), 6)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))
        self._posted()

    @staticmethod
    def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)

    def _add(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms add to the cosine of every example."""
        n = self.start[at + 1] - self.start[at]
        where = self._places(self.start[at], n)
        return np.bincount(self.example[where], np.repeat(w, n) * self.value[where], minlength=len(self.ids))

    def _whole(self, at: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cosines of some examples."""
        n = self.row_start[rows + 1] - self.row_start[rows]
        where = self._places(self.row_start[rows], n)
        self.query[at] = w
        score = np.add.reduceat(self.query[self.row_term[where]] * self.row_value[where], np.cumsum(n) - n)
        self.query[at] = 0
        return score

    def _bounds(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms can add at most to the cosine of an example of each block."""
        n = self.block_start[at + 1] - self.block_start[at]
        where = self._places(self.block_start[at], n)
        return np.bincount(self.block[where], np.repeat(w, n) * self.block_value[where], minlength=self.blocks)

    def dense_parts(self, texts: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """What the terms of dense posting lists add to the cosines of each text (rows) with every example."""
        weights = np.zeros((len(texts), len(self.dense)))
        for row, (terms, counts) in zip(weights, texts):
            at, w = self.vector(terms, counts)
            often = self.dense_of[at] >= 0
            row[self.dense_of[at[often]]] = w[often]
        return weights @ self.dense

    def nearest(self, terms: list[int], counts: list[int], without: int | None = None, dense: np.ndarray | None = None, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, exactly, and the cosines; dense is the text's row of dense_parts."""
        every, weights = self.vector(terms, counts)
        if not len(every) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        if dense is None:
            dense = self.dense_parts([(terms, counts)])[0]
        rare = self.dense_of[every] < 0
        at, w = every[rare], weights[rare]
        order = np.argsort(-w * self.largest[at], kind="stable")
        at, w = at[order], w[order]
        # of the terms from each on: what they can add to any cosine
        rest = np.minimum(np.cumsum((w * self.largest[at])[::-1])[::-1], np.sqrt(np.cumsum((w * w)[::-1])[::-1]))
        first = int((rest > TAIL).sum())
        score = dense + self._add(at[:first], w[:first])
        hit = np.arange(len(self.ids))
        if first < len(at):
            need = k + (without is not None)
            floor = np.partition(score, -need)[-need] if len(score) >= need else 0.0
            near = np.flatnonzero(score + rest[first] >= floor - 1e-9)
            if self._costs(near) > len(at):
                more = np.minimum(self._bounds(at[first:], w[first:]), rest[first])
                near = near[score[near] + more[near // BLOCK] >= floor - 1e-9]
            if self._costs(near) < (self.start[at[first:] + 1] - self.start[at[first:]]).sum():
                hit, score = near, self._whole(every, weights, near)
            else:
                score = score + self._add(at[first:], w[first:])
        some = score > 0
        if without is not None:
            some &= hit != without
        hit, score = hit[some], score[some]
        if len(score) > k:  # only what can be among the k is sorted
            top = score >= np.partition(score, -k)[-k] - 1e-11
            hit, score = hit[top], score[top]
        best = np.lexsort((hit, -np.round(score, 12)))[:k]
        return hit[best], score[best]

    def _costs(self, rows: np.ndarray) -> int:
        return int((self.row_start[rows + 1] - self.row_start[rows]).sum())

    def vote(self, terms: list[int], counts: list[int], id: str | None = None, dense: np.ndarray | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The vote for a document, leaving out the example of its own id; null where no example has a term of it."""
        hit, score = self.nearest(terms, counts, self.place.get(id), dense)
        if not len(hit):
            return None, hit, score
        return float((score @ self.toxic[hit] + PRIOR * self.base) / (score.sum() + PRIOR)), hit, score

    def calibrate(self, votes: list[tuple[float, int]]) -> Index:
        """Platt's curve through (leave-one-out vote, toxic) of the examples, by Newton's method on smoothed targets."""
        v, y = np.array([x for x, _ in votes]), np.array([t for _, t in votes], float)
        pos, neg = y.sum(), len(y) - y.sum()
        if not pos or not neg:
            return self
        goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([v, np.ones_like(v)], 1)
        beta = np.array([6.0, -3.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * (beta - [6.0, -3.0]))
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        if beta[0] > 0:
            self.curve = (float(beta[0]), float(beta[1]))
        return self

    def votes(self, texts: Iterator[tuple[list[int], list[int], str | None]]) -> Iterator[tuple[float | None, str]]:
        """(vote, evidence) of (terms, counts, id) each, BATCH at a time."""
        for batch in batched(texts, BATCH):
            parts = self.dense_parts([(t, c) for t, c, _ in batch])
            for (t, c, i), dense in zip(batch, parts):
                vote, hit, similarity = self.vote(t, c, i, dense)
                yield vote, ",".join(f"{self.ids[h]}:{int(self.toxic[h])}:{s:.4f}" for h, s in zip(hit[:3], similarity[:3]))


def _voting(shared):
    """(vote, evidence) of each row, beside all columns but its terms; a null vote where there is no near example."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            found = list(index.votes(zip(pdf["terms"], pdf["counts"], pdf["id"])))
            yield pdf.drop(columns=["terms", "counts"]).assign(vote=[v for v, _ in found], evidence=[e for _, e in found])

    return run


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, score, evidence (example:label:similarity of the three nearest)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    share = spark.sparkContext.broadcast
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # ids travel as text: pandas would turn whole numbers beside a null into doubles
    source = docs.select(row.alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # at most `examples` rows of 12 bytes
    sample = cut(sample_labels(labels, examples).withColumn("id", F.col("id").cast("string")))
    texts = written(source.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    chosen, relevance = relevant_terms(texts.select("toxic", "text"))
    counting = _counting(share(zlib.compress("\n".join(chosen).encode())))
    vectors = written(source.mapInPandas(counting, "row long, id string, terms array<int>, counts array<int>"))
    n = vectors.count()
    seen = np.zeros(len(chosen))
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pandas()  # one row a term
    seen[found["term"].to_numpy(np.int64)] = found["count"].to_numpy(float)
    known = written(texts.mapInPandas(counting, "id string, toxic int, terms array<int>, counts array<int>"))
    rows = known.sort(F.col("id").cast(kind), "id").toArrow().to_pandas()
    index = Index((np.log((1 + n) / (1 + seen)) + 1) * relevance).build(list(zip(rows["id"], rows["toxic"].tolist(), rows["terms"], rows["counts"])))
    voting = _voting(share(index))
    own = known.repartition(max(1, math.ceil(len(rows) / CALIBRATED))).mapInPandas(voting, "id string, toxic int, vote double, evidence string")
    index.calibrate([(r["vote"], r["toxic"]) for r in own.where("vote is not null").sort("id").select("vote", "toxic").collect()])
    dealt = vectors.repartition(max(1, math.ceil(n / SCORED)))
    voted = dealt.mapInPandas(voting, "row long, id string, vote double, evidence string")
    curve, vote = index.curve, F.col("vote")
    if curve:
        vote = 1 / (1 + F.exp(-(F.lit(curve[0]) * vote + F.lit(curve[1]))))
    return voted.select("row", F.col("id").cast(kind).alias("id"), F.coalesce(vote, F.lit(float(index.prior))).alias("score"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options: object) -> DataFrame:
    """docs without the rows scored at limit or above."""
    rows, row = numbered(docs)
    return without(rows, row, toxic_scores(rows, labels, row_col=row, **options).where(F.col("score") >= limit))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
