"""Exact dedup by a heavy-hitter split.

Misra-Gries counters, kept per partition and merged, name every digest that more than ``support`` of all
rows carry. One combinable aggregate verifies them (exact count and kept row); at most 1/support winners of
under 100 bytes are broadcast, and the rows that carry them are decided where they lie. The other digests, of
which none is frequent, are counted by one combinable aggregate and joined back to ids and digests; texts are
never shuffled.

Cases: a null text is an empty one, and a very long one is hashed whole; a null id is larger than any other; of rows
that repeat id and text one stays; an empty table gives no rows; other columns are ignored, and carried by
``drop_duplicates`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, cut, numbered, table, without


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, id, digest): SHA-256 of the text with each run of white space as one space; row is row_col, or counted."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " ")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def heavy_digests(rows: DataFrame, support: float) -> DataFrame:
    """(digest, n, first): verified winners among the Misra-Gries candidates, 1/support rows at most."""
    # as text: the counters compare values, and byte arrays only by identity
    counted = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    candidates = counted.select(F.explode("digest_freqItems").alias("text")).select(F.unhex("text").alias("digest"))
    return rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).where("n > 1")


def _order():
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row, id, digest, keep_id, group_size, kept."""
    rows = cut(digest_rows(docs, id_col, text_col, row_col))
    marked = rows.join(F.broadcast(cut(heavy_digests(rows, support))), "digest", "left")
    rest = marked.where("n is null").select("row", "id", "digest")
    light = rest.join(rest.groupBy("digest").agg(F.count("*").alias("n"), F.min(_order()).alias("first")), "digest")
    columns = ("row", "id", "digest", "n", "first")
    every = light.select(*columns).unionByName(marked.where("n is not null").select(*columns))
    return every.select("row", "id", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """docs without the rows that another row's text repeats."""
    rows, row = numbered(docs)
    return without(rows, row, exact_groups(rows, id_col, text_col, support, row).where("not kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
