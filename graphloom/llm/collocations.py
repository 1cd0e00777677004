"""Phrase collocations from vertical inverted lists of positions.

Texts are dealt into blocks of one language. A block holds, sorted by position, the postings of its frequent words and
the occurrences of its frequent phrases; positions jump at the ends of pieces. A phrase grows by a merge join of the
positions behind its occurrences with the postings: the joined list is that of the longer phrase, and its length is the
phrase's exact frequency in the block. The lengths of all blocks meet by a hash of the phrase, and each block gets back
the phrases that are frequent in all, named by their first (block, place). A block tells of each phrase once, so the
most frequent phrase has one entry a block; the entries of a block that go one way travel as one packed row. Blocks,
lists and frequent phrases are tables in the shared folder; none is broadcast and none passes through the driver.

Words that are seldom cannot lie in a frequent phrase, and an occurrence grows only where the phrase that starts one
word later is frequent too; both leave every frequency as it is.

Cases: null and empty texts have no words; a null language counts as ``und``, with texts of that very language; a
text longer than a block is a block of its own, in one worker that holds it; repeated rows count each time; ties in
score go to the more frequent phrase, then to UTF-8 order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import shared_dir
from . import splits
from .common import table, written
from .splits import kinds, lists_of_one, lots, packed, packed_records, released, unpacked, unpacked_records, words

KIND = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: A phrase is named by block and place in the block's list: so many bits for the place, and for a task's own blocks.
PLACE_BITS, BLOCK_BITS = 28, 13
FIRST, LEAST, LONGEST, COVERED = 2000, 30, 4, 80

BLOCKS = "block long, lang string, n long, words array<string>, counts array<long>, codes binary"
#: p_* are the phrases' lists, w_* the words' postings: positions, local numbers, and the names of those.
LISTS = "block long, w_at binary, w_of binary, w_name binary, p_at binary, p_of binary, p_name binary"
#: Lists' lengths of one block for one part of all phrases; the entries of a part, on average, at most.
LENGTHS, PART = "part long, block long, entries binary", 1 << 21
ENTRY = np.dtype([("phrase", "<i8"), ("word", "<i8"), ("place", "<i4"), ("n", "<i4")])
#: Of a part and a block: places and names of its frequent phrases, and what is new in phrases first met there.
FREQUENT = "block long, names binary, phrases binary"
NAMED = np.dtype([("place", "<i4"), ("name", "<i8")])
PHRASE = np.dtype([("name", "<i8"), ("phrase", "<i8"), ("word", "<i8"), ("total", "<i8")])
PHRASES = "name long, phrase long, word long, total long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << BLOCK_BITS, 0
    waiting: dict[str, list[pa.Array]] = {}

    def block(lang: str, texts: list[pa.Array]) -> pa.RecordBatch:
        nonlocal made
        if made >> BLOCK_BITS:
            raise ValueError("too many blocks in one task: read smaller partitions")
        text, piece, word = words(pa.concat_arrays([t.cast(pa.large_string()) for t in texts]), KIND, lower=True)
        coded = word.dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(len(of)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
        codes = np.full(int(at[-1]) + 1 if len(at) else 0, -1, np.int32)
        codes[at] = of
        made += 1
        counts = np.bincount(of, minlength=len(coded.dictionary))
        return pa.RecordBatch.from_arrays(
            [pa.array([first + made - 1]), pa.array([lang]), pa.array([len(of)]), lists_of_one(coded.dictionary.cast(pa.string())), lists_of_one(pa.array(counts)), pa.array([packed(codes)])],
            names=[c.split()[0] for c in BLOCKS.split(", ")],
        )

    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        for lang in langs.unique().to_pylist():
            mine = texts.filter(pc.equal(langs, lang))
            for a, b in lots(mine):
                some = mine.slice(a, b - a)
                ready = waiting.get(lang, [])
                if ready and sum(t.nbytes for t in ready) + some.nbytes > splits.LOT:
                    yield block(lang, waiting.pop(lang))
                waiting.setdefault(lang, []).append(some)
        while sum(t.nbytes for ts in waiting.values() for t in ts) > 2 * splits.LOT:  # many languages: the largest goes first
            lang = max(waiting, key=lambda x: sum(t.nbytes for t in waiting[x]))
            yield block(lang, waiting.pop(lang))
    for lang in list(waiting):
        yield block(lang, waiting.pop(lang))
    released()


def merge(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two sorted lists of positions: which of at occur, and where in the other list."""
    if not len(of):
        return np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    where = np.minimum(np.searchsorted(of, at), len(of) - 1)
    return of[where] == at, where


class Lists:
    """The lists of one block: postings of words and occurrences of phrases of size words."""

    def __init__(self, row: dict, size: int) -> None:
        read = lambda c: (unpacked(row[f"{c}_at"], rising=True), unpacked(row[f"{c}_of"]), unpacked(row[f"{c}_name"], width=8))
        self.size, self.block = size, row["block"]
        self.w_at, self.w_of, self.w_name = words_ = read("w")
        self.p_at, self.p_of, self.p_name = words_ if size == 1 else read("p")

    def grown(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the phrases of one word more, the number of each, and of each number its phrase and its word."""
        follows, _ = merge(self.p_at + 1, self.p_at)
        at, of = self.p_at[follows], self.p_of[follows]
        hit, where = merge(at + self.size, self.w_at)
        keys, number = np.unique(of[hit].astype(np.int64) * max(1, len(self.w_name)) + self.w_of[where[hit]], return_inverse=True)
        return at[hit], number, keys // max(1, len(self.w_name)), keys % max(1, len(self.w_name))


def _row(block: int, postings: tuple, phrases: tuple | None) -> pa.Table:
    cells = []
    for at, of, name in (postings, phrases or (np.zeros(0, np.int64),) * 3):
        cells += [packed(at, rising=True), packed(of), packed(name, width=8)]
    names = [c.split()[0] for c in LISTS.split(", ")]
    return pa.table(dict(zip(names, [pa.array([block]), *(pa.array([c]) for c in cells)])))


def _none() -> pa.Table:
    return pa.table({c.split()[0]: pa.array([], pa.int64() if c.endswith("long") else pa.binary()) for c in LISTS.split(", ")})


def _chosen(frequent: pa.Table, total: int) -> tuple[np.ndarray, np.ndarray]:
    """New numbers of a block's old ones, -1 for those that are not frequent, and the names of the new ones."""
    if "names" in frequent.column_names:
        found = np.concatenate([unpacked_records(b, NAMED) for b in frequent.column("names").to_pylist()])
        place, name = found["place"], found["name"]
    else:
        place, name = frequent.column("place").to_numpy(), frequent.column("name").to_numpy()
    new = np.full(total + 1, -1, np.int64)  # the last one stands for the gaps between pieces
    new[place] = np.arange(len(place))
    return new, name


def _first_lists(block: pa.Table, frequent: pa.Table) -> pa.Table:
    if not block.num_rows or not frequent.num_rows:
        return _none()
    codes = unpacked(block.column("codes")[0].as_py())
    new, name = _chosen(frequent, int(codes.max()) + 1)
    of = new[codes]
    at = np.flatnonzero(of >= 0)
    beside = merge(at + 1, at)[0] | merge(at - 1, at)[0]
    at = at[beside]
    return _row(block.column("block")[0].as_py(), (at, of[at], name), None)


def _next_lists(size: int):
    def run(block: pa.Table, frequent: pa.Table) -> pa.Table:
        if not block.num_rows or not frequent.num_rows:
            return _none()
        lists = Lists(block.to_pylist()[0], size)
        at, number, phrase, _ = lists.grown()
        new, name = _chosen(frequent, len(phrase))
        of = new[number]
        at, of = at[of >= 0], of[of >= 0]
        # postings behind these phrases are all that can be asked for from now on
        keep, _ = merge(lists.w_at, at + size + 1)
        return _row(lists.block, (lists.w_at[keep], lists.w_of[keep], lists.w_name), (at, of, name))

    return run


def _part(phrase: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    """A hash of two names; a phrase goes to one part from all blocks."""
    mixed = (phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)) % np.uint64(parts)


def _lengths(size: int, parts: int):
    """One row for each part that a block has phrases of size + 1 words in: phrase and word by name, place, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lists = Lists(batch.slice(k, 1).to_pylist()[0], size)
                _, number, phrase, word = lists.grown()
                entries = np.zeros(len(phrase), ENTRY)
                entries["phrase"], entries["word"] = lists.p_name[phrase], lists.w_name[word]
                entries["place"], entries["n"] = np.arange(len(phrase)), np.bincount(number, minlength=len(phrase))
                part = _part(entries["phrase"], entries["word"], parts)
                order = np.argsort(part, kind="stable")
                there, starts = np.unique(part[order], return_index=True)
                rows = []
                for some in np.split(order, starts[1:]) if len(there) else []:
                    mine = entries[some]
                    mine["place"] = np.diff(mine["place"], prepend=0)  # places rise; their differences pack better
                    rows.append(packed_records(mine))
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(np.full(len(there), lists.block)), pa.array(rows, pa.binary())], names=["part", "block", "entries"])
                released()

    return run


def _counted(least: int):
    """The phrases of a part that are frequent in all blocks, back to the blocks that hold them."""

    def run(rows: pa.Table) -> pa.Table:
        found = [unpacked_records(b, ENTRY).copy() for b in rows.column("entries").to_pylist()]
        for f in found:
            f["place"] = np.cumsum(f["place"])
        blocks = np.repeat(rows.column("block").to_numpy(), [len(f) for f in found])
        entries = np.concatenate(found)
        order = np.lexsort((entries["place"], blocks, entries["word"], entries["phrase"]))
        entries, blocks = entries[order], blocks[order]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["phrase"][1:] != entries["phrase"][:-1]) | (entries["word"][1:] != entries["word"][:-1])
        starts = np.flatnonzero(new)
        totals, of = np.add.reduceat(entries["n"].astype(np.int64), starts), np.cumsum(new) - 1
        keep = np.flatnonzero(totals[of] >= least)
        names = np.zeros(len(keep), NAMED)
        first = starts[of[keep]]
        names["place"], names["name"] = entries["place"][keep], (blocks[first] << PLACE_BITS) + entries["place"][first]
        phrases = np.zeros(len(keep), PHRASE)
        for c in ("phrase", "word"):
            phrases[c] = entries[c][keep]
        phrases["name"], phrases["total"] = names["name"], totals[of[keep]]
        here, opens = blocks[keep], keep == first
        order = np.lexsort((names["place"], here))
        there, begins = np.unique(here[order], return_index=True)
        groups = np.split(order, begins[1:]) if len(there) else []
        cells = [(packed_records(names[g]), packed_records(phrases[g[opens[g]]])) for g in groups]
        return pa.table({"block": there, "names": pa.array([c[0] for c in cells], pa.binary()), "phrases": pa.array([c[1] for c in cells], pa.binary())})

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("phrases").to_pylist():
            found = unpacked_records(data, PHRASE)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in PHRASE.names], names=list(PHRASE.names))


def _bucketed(lists: DataFrame) -> DataFrame:
    """The table of lists, once, in the shared folder and in buckets of blocks."""
    spark = lists.sparkSession
    name = f"lists_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, "block").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; found and its files stay
    return found


def _frequent(rows: DataFrame, least: int, *keys: str) -> DataFrame:
    """(slot, name) of the rows whose key is frequent in all blocks; name is the first slot that holds it, and there alone
    stand the key and its total."""
    same = Window.partitionBy(*keys)
    found = rows.withColumns({"total": F.sum("n").over(same), "name": F.min("slot").over(same)}).where(F.col("total") >= least)
    return written(found.select("slot", "name", *(F.when(F.col("slot") == F.col("name"), F.col(c)).alias(c) for c in (*keys, "total"))))


def _by_block(frequent: DataFrame):
    mask = (1 << PLACE_BITS) - 1
    return frequent.select(F.shiftright("slot", PLACE_BITS).alias("block"), F.col("slot").bitwiseAND(mask).alias("place"), "name").groupBy("block")


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both) in decimals, since the product may pass 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(19,0)"), both.cast("decimal(20,0)"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every candidate: lang, phrase, size, a, l, r, n, score, and whether a longer one covers it (dropped)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _bucketed(texts.mapInArrow(_blocks, BLOCKS))
    of_lang = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (blocks.agg(F.sum("n")).first()[0] or 0) // PART)
    # counts of words: one row for each block that holds a word
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    each = each.select(((F.col("block") * (1 << PLACE_BITS)) + F.col("place")).alias("slot"), "lang", F.col("x.words").alias("text"), F.col("x.counts").alias("n"))
    frequent = _frequent(each, least, "lang", "text")
    lists = _bucketed(blocks.select("block", "codes").groupBy("block").cogroup(_by_block(frequent)).applyInArrow(_first_lists, LISTS))
    single = frequent.where("slot = name").select("name", "lang", "text", F.array("total").alias("heads"), F.array("total").alias("tails"), F.lit(None).cast("long").alias("rest"))
    word = single.select(F.col("name").alias("word"), F.col("text").alias("last"))
    known, shorter, found = single, None, []
    for size in range(1, longest):
        counted = written(lists.mapInArrow(_lengths(size, parts), LENGTHS).groupBy("part").applyInArrow(_counted(least), FREQUENT))
        if size + 1 < longest:
            lists = _bucketed(lists.groupBy("block").cogroup(counted.select("block", "names").groupBy("block")).applyInArrow(_next_lists(size), LISTS))
        here = written(counted.select("phrases").mapInArrow(_phrases, PHRASES))
        head = known.select(F.col("name").alias("phrase"), "lang", "text", "heads", F.col("rest").alias("within"))
        grown = here.join(head, "phrase").join(word, "word")
        if shorter is None:
            grown = grown.withColumn("rest", F.col("word"))
        else:  # all but the first word: the phrase that starts one word later
            grown = grown.join(shorter.select(F.col("phrase").alias("within"), "word", F.col("name").alias("rest")), ["within", "word"])
        grown = grown.join(known.select(F.col("name").alias("rest"), F.col("tails").alias("behind")), "rest")
        known = written(
            grown.select("name", "lang", F.concat_ws(" ", "text", "last").alias("text"), F.concat("heads", F.array("total")).alias("heads"), F.concat(F.array("total"), "behind").alias("tails"), "rest", F.col("phrase").alias("front"), "total")
        )
        shorter = here
        found.append(known)
    out = []
    for k, each in enumerate(found):
        cuts = [(F.col("heads")[c], F.col("tails")[c + 1]) for c in range(k + 1)]
        lowest = F.array_min(F.array(*(F.struct(_score(F.col("total"), a + b).alias("score"), F.lit(c).alias("cut"), a.alias("l"), b.alias("r")) for c, (a, b) in enumerate(cuts))))
        each = each.withColumn("best", lowest)
        if k + 1 < len(found):
            # a phrase inside a much longer one lies inside one of one word more, which is at least as frequent
            longer = found[k + 1]
            most = longer.select(F.col("front").alias("name"), "total").union(longer.select("rest", "total")).groupBy("name").agg(F.max("total").alias("most"))
            each = each.join(most, "name", "left")
        else:
            each = each.withColumn("most", F.lit(None).cast("long"))
        dropped = F.coalesce(F.col("most") * 100 >= F.col("total") * covered, F.lit(False))
        out.append(each.select("lang", F.col("text").alias("phrase"), F.lit(k + 2).alias("size"), F.col("total").alias("a"), "best.l", "best.r", F.col("best.score").cast("long").alias("score"), dropped.alias("dropped")))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every.join(of_lang, "lang")


def leading(found: DataFrame, first: int = FIRST) -> DataFrame:
    """Each language's first rows by score, frequency and phrase. Each of many parts of a language is ranked before
    the language is, so that no task sorts all its phrases."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "part").orderBy(*order)
    parted = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= first)
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first).drop("part")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases(table(spark, sf_dir, "documents")).where("not dropped")
    return leading(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM lists, range(1, 5) AS t(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ones AS (
  SELECT lang, inside, max(a) AS most FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS inside
    FROM candidates, range(2, 4) AS t(size) WHERE size < k
  ) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ones ON inner_ones.lang = best.lang AND inner_ones.inside = best.phrase
  WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= 2000
"""
