"""What the operators share: word rules, row ids, shared-folder tables, components."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import shared_dir

#: Runs of the six ASCII white-space characters; a word is a run of anything else.
WS = r"[\x20\x09-\x0D]+"
#: Lists of row numbers (8 bytes each) up to this length are broadcast.
BROADCAST_ROWS = 1_000_000
#: Lists of file names (some 100 bytes each) up to this length are broadcast.
FILES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, and cuts its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), for wide rows: a compressed columnar table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number, and the number's column name.

    Stages that return whole rows decide by number and read the rows again. So numbers, and the rows themselves, must
    not change with a lost executor or another division into tasks. Only the rows of files that are read as they stand,
    with columns chosen and rows filtered by what they hold, are numbered by file and place in the file; the rows of
    any other frame (samples, random filters, deduplications, joins, unions) are drawn once and written, numbered, to
    the shared folder.
    """
    row = fresh(docs, "row")
    placed = _placed(docs, row) if _stands(docs) else None
    return placed if placed is not None else written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _stands(docs: DataFrame) -> bool:
    """Whether the rows are those of files, chosen by nothing but their own values."""
    try:
        plan = docs._jdf.queryExecution().analyzed()
    except AttributeError:  # a remote session does not show its plans
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def _placed(docs: DataFrame, row: str) -> DataFrame | None:
    """docs numbered by place; None where its files do not tell places, or are more than FILES."""
    path, at, n = (fresh(docs, x) for x in ("path", "at", "file_number"))
    try:
        meta = docs.metadataColumn("_metadata")
        found = docs.withColumns({path: meta["file_path"], at: meta["row_index"]})
    except AnalysisException:  # no files, or a format without places
        return None
    files = sorted(r[0] for r in found.select(path).distinct().limit(FILES + 1).collect())
    if len(files) > FILES:
        return None
    number = docs.sparkSession.createDataFrame([(f, k << 36) for k, f in enumerate(files)], f"`{path}` string, `{n}` long")
    return found.join(F.broadcast(number), path).withColumn(row, F.col(n) + F.col(at)).drop(path, at, n)


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of a numbered table that gone(row) does not name, without the number.

    The list of gone rows is broadcast up to BROADCAST_ROWS, so that no text is shuffled; a longer one is shuffled.
    """
    gone = cut(gone.select(F.col("row").alias(row)))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row, "left_anti").drop(row)


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b); root is the smallest node reachable.

    Labels move along edges by their minimum and then jump to the label of their label, so the number
    of rounds follows the logarithm of the longest path. Every step is an equi-join or a combinable
    minimum: a hub's edges are never gathered in one task. Each round is cut into the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # a root is itself a node, with a label of its own
        jumped = moved.join(label.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        now = cut(jumped.select("node", F.least("root", "far").alias("root"), (F.least("root", "far") < F.col("was")).alias("changed")))
        label = now.select("node", "root")
        if now.where("changed").isEmpty():
            return label
