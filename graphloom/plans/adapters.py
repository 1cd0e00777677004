"""The driver's tables as graph data, once for Spark and once as SQL common table expressions.

E-bip  lineitem as edges supplier -> 1000000 + part.   E-seq  events as walks of users over the nodes of ``props``.
SN     ten snarls e: entry 10e, exit 10e + 5.           I-ord  orders as intervals of 7 days by customer.
AL     parts as haplotypes: site brand, allele type|size.
BUB    orders as walks over bubbles: at line n one of the nodes 10n, 10n + 1, 10n + 2; snarls from 10e to 10(e + 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bipartite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))


BIP = "e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem)"


def walks(spark: SparkSession, sf: str) -> DataFrame:
    """walks(walk, step, node, fwd, len)."""
    node = F.get_json_object("props", "$.k").cast("bigint")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf, "events").select(F.col("user_id").alias("walk"), step.cast("bigint").alias("step"), node.alias("node"), (F.col("event_type") != "error").alias("fwd"))
    return rows.withColumn("len", 1 + F.col("node") % 7)


WALKS = """w AS (SELECT user_id AS walk, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
  CAST(json_extract(props, '$.k') AS BIGINT) AS node, event_type <> 'error' AS fwd, 1 + CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS len FROM events)"""


def walk_edges(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import step_pairs

    return step_pairs(walks(spark, sf)).select("src", "dst")


EDGES = WALKS + """, e AS (SELECT src, dst FROM (SELECT node AS src, lead(node) OVER (PARTITION BY walk ORDER BY step) AS dst FROM w) WHERE dst IS NOT NULL)"""
OFFSETS = WALKS + """, o AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY walk ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
  CAST(sum(len) OVER (PARTITION BY walk ORDER BY step) AS BIGINT) AS e FROM w)"""


def snarls(spark: SparkSession, kind: str = "acyclic") -> DataFrame:
    return spark.range(10).select(F.col("id").alias("snarl"), F.lit(kind).alias("kind"), (F.col("id") * 10).alias("entry"), (F.col("id") * 10 + 5).alias("exit"), F.lit(None).cast("bigint").alias("parent"))


SNARLS = "sn AS (SELECT range AS snarl, range * 10 AS entry, range * 10 + 5 AS exit FROM range(10))"


def customer_intervals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("bigint")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), day.alias("start"), (day + 7).alias("end"))


INTERVALS = "i AS (SELECT o_custkey AS cust, d AS s, d + 7 AS e FROM (SELECT o_custkey, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d FROM orders))"
MERGED = INTERVALS + """, m1 AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT * FROM i)),
m2 AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e) AS g FROM m1),
m AS (SELECT cust, min(s) AS s, max(e) AS e FROM m2 GROUP BY cust, g)"""


def allele_calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("hap"), F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("label"))


ALLELES = "a AS (SELECT p_brand AS site, p_partkey AS hap, p_type || '|' || p_size AS label FROM part)"
PANEL = ALLELES + """, c AS (SELECT site, label, count(*) AS n FROM a GROUP BY 1, 2),
p0 AS (SELECT site, CASE WHEN n >= 2 OR label IN ('AMBIGUOUS_PARALOG', 'MISSING') THEN label ELSE 'OTHER' END AS label,
  NOT (n >= 2 OR label IN ('AMBIGUOUS_PARALOG', 'MISSING')) AS rest, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2, 3),
p AS (SELECT site, label, n, n / sum(n) OVER (PARTITION BY site) AS frequency, CAST(row_number() OVER (PARTITION BY site ORDER BY rest, n DESC, label) - 1 AS BIGINT) AS idx FROM p0),
r AS (SELECT site, max_by(idx, (frequency, -idx)) AS ref, count(*) AS k FROM p GROUP BY 1)"""


def dna(spark: SparkSession, sf: str) -> DataFrame:
    """(node, seq) of part names mapped to bases."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTacgtACGTNacgtACGTNA").alias("seq"))


DNA = "d AS (SELECT p_partkey AS node, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTacgtACGTNacgtACGTNA') AS seq FROM part)"


def bubbles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """walks, snarls and readings(individual, node, value): every fourth order alone and certain, the others in threes."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("flag"), F.min("l_discount").alias("d"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    rows = lines.select(order.alias("walk"), (line - 1).alias("step"), (line * 10 + F.col("p") % 3).alias("node"), (F.col("flag") != "R").alias("fwd"), "d")
    sites = spark.range(1, 6).select(F.col("id").alias("snarl"), F.lit("acyclic").alias("kind"), (F.col("id") * 10).alias("entry"), (F.col("id") * 10 + 20).alias("exit"), F.lit(None).cast("bigint").alias("parent"))
    sure = F.col("walk") % 4 == 0
    readings = rows.select(F.when(sure, F.col("walk")).otherwise(F.col("walk") - F.col("walk") % 4 + 1).alias("individual"), "node", F.when(sure, 1.0).otherwise(F.col("d") * 10).alias("value"))
    return rows.drop("d"), sites, readings


BUBBLES = """b AS (SELECT l_orderkey AS walk, CAST(l_linenumber AS BIGINT) AS line, min(l_partkey) AS p, min(l_returnflag) <> 'R' AS fwd, min(l_discount) AS d FROM lineitem GROUP BY 1, 2),
w AS (SELECT walk, line - 1 AS step, line * 10 + p % 3 AS node, fwd, d FROM b), sn AS (SELECT range AS snarl, range * 10 AS entry, range * 10 + 20 AS exit FROM range(1, 6)),
z AS (SELECT CASE WHEN walk % 4 = 0 THEN walk ELSE walk - walk % 4 + 1 END AS individual, node, sum(CASE WHEN walk % 4 = 0 THEN 1 ELSE least(greatest(d * 10, 0), 1) END) AS value FROM w GROUP BY 1, 2)"""


#: Steps of one W line of graph_text, and the gap on the contig between two lines of a walk.
LINE_STEPS, GAP = 40, 1000


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """E-seq cut into fragments: walk, step (within the fragment), node, fwd, len, first (the fragment's start)."""
    from ..operators.coords import offsets

    placed = offsets(walks(spark, sf)).withColumn("part", F.floor(F.col("step") / LINE_STEPS))
    starts = placed.groupBy("walk", "part").agg((F.min("start") + F.col("part") * GAP).alias("first"))
    name = F.concat(F.lit("u"), F.col("walk").cast("string"), F.lit("#1#chr1"))
    return placed.join(starts, ["walk", "part"]).select(name.alias("name"), "walk", "first", (F.col("step") % LINE_STEPS).alias("step"), "node", "fwd", "len")


def graph_text(spark: SparkSession, sf: str) -> str:
    """The path of E-seq as graph text: a segment for each node, its links, and a W line for each fragment."""
    import uuid

    from ..operators.index import shared_dir

    steps = fragments(spark, sf)
    segs = steps.groupBy("node").agg(F.max("len").alias("len")).select(F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), F.expr("repeat('A', int(len))")).alias("value"))
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    from ..operators.graph import step_pairs

    pairs = step_pairs(walks(spark, sf)).select("src", "src_fwd", "dst", "dst_fwd").distinct()
    links = pairs.select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), sign("src_fwd"), F.col("dst").cast("string"), sign("dst_fwd"), F.lit("0M")).alias("value"))
    step = F.struct("step", F.concat(F.when(F.col("fwd"), ">").otherwise("<"), F.col("node").cast("string")).alias("s"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["s"]), "")
    lines = steps.groupBy("walk", "first").agg(joined.alias("s"), F.sum("len").alias("len"))
    w = lines.select(F.concat_ws("\t", F.lit("W"), F.concat(F.lit("u"), F.col("walk").cast("string")), F.lit("1"), F.lit("chr1"), F.col("first").cast("string"), (F.col("first") + F.col("len")).cast("string"), F.col("s")).alias("value"))
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    segs.union(links).union(w).write.text(path)
    return path


FRAGMENTS = OFFSETS + f""", fs AS (SELECT walk, step // {LINE_STEPS} AS part, CAST(min(s) + step // {LINE_STEPS} * {GAP} AS BIGINT) AS first FROM o GROUP BY 1, 2),
fr AS (SELECT 'u' || o.walk || '#1#chr1' || CASE WHEN first > 0 THEN '[' || first || ']' ELSE '' END AS walk, 'u' || o.walk AS sample, first, step % {LINE_STEPS} AS step, node, fwd, len,
  CAST(first + sum(len) OVER (PARTITION BY o.walk, part ORDER BY step) - len AS BIGINT) AS s FROM o JOIN fs ON fs.walk = o.walk AND fs.part = o.step // {LINE_STEPS}),
gn AS (SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT node FROM w))"""
