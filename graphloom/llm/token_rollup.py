"""Token counts: additive rollups by source, language and tokenizer version, kept by signed deltas.

An event inserts a document's count, deletes it, or revises it (the old count out, the new one in). A batch of events
is reduced to one signed row for each key by a combinable aggregate, so a key with a third of all rows is a few
partial sums, and is committed as a small table under the batch's own name: written beside, then published by one
rename. A batch whose name has been committed is left alone, and one that was lost half-way is written anew: a commit
may be repeated at any time, as a streaming ``foreachBatch`` does. Totals are the sum of the committed batches;
``compact`` replaces many by one table of totals and one of their names, so that replays count once after it too. The
folder must lie in a file system whose renames are atomic.

Cases: a very long text is counted whole by one worker; null sources and languages are keys of their own; a null or empty text counts 0 tokens and one document; a null
count is 0; repeated rows count as often as they occur; a key whose documents and tokens both come to 0 is left out;
an empty table, or an empty batch, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import n_words, shared_dir, table, written
from .tokens import encode

KEY = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas that add counts(source, lang, tokenizer, tokens)."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take counts(source, lang, tokenizer, tokens) out again."""
    return inserts(counts).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(counts: DataFrame) -> DataFrame:
    """Deltas of counts(source, lang, tokenizer, old_tokens, tokens): the documents stay."""
    change = F.coalesce(F.col("tokens"), F.lit(0)) - F.coalesce(F.col("old_tokens"), F.lit(0))
    return counts.select(*KEY, F.lit(0).cast("long").alias("docs"), change.cast("long").alias("tokens"))


def reduced(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, state: str, prefix: str) -> list[str]:
    """The names of the published folders of a kind, in order."""
    fs, at = _fs(spark, state)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def _publish(spark: SparkSession, state: str, name: str, tables: dict[str, DataFrame]) -> bool:
    """Writes tables into a staged folder and renames it as a whole to ``name``; False where another got there first.

    A rename onto a folder that is there already fails or lands inside it under the staged name, which begins with an
    underscore and which no reader looks at; either way the first to publish stays.
    """
    staged = f"_staged-{uuid.uuid4().hex}"
    for k, df in tables.items():
        df.write.parquet(f"{state}/{staged}/{k}")
    fs, source = _fs(spark, f"{state}/{staged}")
    _, target = _fs(spark, f"{state}/{name}")
    _, inside = _fs(spark, f"{state}/{name}/{staged}")
    won = not fs.exists(target) and fs.rename(source, target) and not fs.exists(inside)
    for lost in () if won else (inside, source):
        if fs.exists(lost):
            fs.delete(lost, True)
    return won


def _batch(batch: str) -> str:
    return "batch-" + quote(batch, safe="")


def _compacted(spark: SparkSession, state: str) -> tuple[str | None, DataFrame]:
    """The newest compaction, and names(name) of the batches it holds."""
    last = _folders(spark, state, "compact-")[-1:]
    if not last:
        return None, spark.createDataFrame([], "name string")
    return last[0], spark.read.schema("name string").parquet(f"{state}/{last[0]}/names")


def _open(spark: SparkSession, state: str, names: DataFrame) -> list[str]:
    """The published batches that no compaction holds."""
    there = _folders(spark, state, "batch-")
    if not there:
        return []
    known = {r["name"] for r in names.join(F.broadcast(spark.createDataFrame([(n,) for n in there], "name string")), "name", "left_semi").collect()}
    return [n for n in there if n not in known]


def committed(spark: SparkSession, state: str, batch: str) -> bool:
    fs, at = _fs(spark, f"{state}/{_batch(batch)}")
    return fs.exists(at) or not _compacted(spark, state)[1].where(F.col("name") == _batch(batch)).isEmpty()


def commit(state: str, batch: str, deltas: DataFrame) -> bool:
    """Adds a batch to the rollup in the folder ``state``; False if it had been added before."""
    spark = deltas.sparkSession
    if committed(spark, state, batch):
        return False
    return _publish(spark, state, _batch(batch), {"deltas": reduced(deltas)})


def _summed(spark: SparkSession, state: str, last: str | None, open_: list[str]) -> DataFrame:
    paths = [f"{state}/{n}/deltas" for n in open_] + ([f"{state}/{last}/deltas"] if last else [])
    rows = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    return reduced(rows).where("docs <> 0 or tokens <> 0")


def totals(spark: SparkSession, state: str) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) over all committed batches."""
    last, names = _compacted(spark, state)
    return _summed(spark, state, last, _open(spark, state, names))


def compact(spark: SparkSession, state: str) -> int:
    """Replaces the batches by one table of totals and one of their names; returns how many batches it took in.

    The two tables are published as one folder before anything is deleted, and batches that a compaction names are
    not counted again, so it may be stopped at any point. Names stay known: an old batch that comes again is left alone.
    One compaction runs at a time, and no reader holds a frame of ``totals`` from before it.
    """
    last, names = _compacted(spark, state)
    open_ = _open(spark, state, names)
    if open_:
        number = int(last.split("-")[1]) + 1 if last else 0
        added = spark.createDataFrame([(n,) for n in open_], "name string")
        if not _publish(spark, state, f"compact-{number:09d}", {"deltas": _summed(spark, state, last, open_), "names": names.unionByName(added)}):
            return 0
    newest, names = _compacted(spark, state)
    left = set(_folders(spark, state, "batch-")) - set(_open(spark, state, names))
    for name in [*left, *(n for n in _folders(spark, state, "compact-") if n != newest)]:
        fs, at = _fs(spark, f"{state}/{name}")
        fs.delete(at, True)
    return len(open_)


def bpe_tokens(folder: str | None = None):
    """A function of a text column: its number of byte_bpe_50k ids."""

    def count(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series([len(encode(t, folder)) for t in texts], dtype="int64")

    return F.pandas_udf(count, LongType())


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizers: byte_bpe_50k is loaded with word counts and then revised to its own; words
    loses the documents without a word. The revision is committed twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    counts = written(docs.select("source", "lang", n_words(F.col("text")).alias("words"), bpe_tokens()(F.col("text")).alias("bpe")))
    state = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    words = counts.select("source", "lang", F.lit("words").alias("tokenizer"), F.col("words").alias("tokens"))
    bpe = counts.select("source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), F.col("words").alias("old_tokens"), F.col("bpe").alias("tokens"))
    commit(state, "load", inserts(words.unionByName(bpe.select(*KEY, F.col("old_tokens").alias("tokens")))))
    commit(state, "revise", revisions(bpe))
    commit(state, "purge", deletes(words.where("tokens = 0")))
    commit(state, "revise", revisions(bpe))
    return totals(spark, state)
