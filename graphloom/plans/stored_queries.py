"""Queries over files that are first written from the driver's tables, so that readers and writers are held to SQL too."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import banded, generators, graph, haplotypes, krylov, layout, position_index, raster
from ..operators.index import shared_dir, stored
from ..sources import keyed_text, sinks, tables
from . import adapters as A
from . import pipelines as P
from .queries import query


@query(f"WITH {A.FRAGMENTS} SELECT walk, step, idx AS node, fwd, len FROM fr JOIN gn USING (node)")
def gfa_walks(spark, sf):
    """W lines read back: each fragment is a walk of its own."""
    return P.bundle(spark, A.graph_text(spark, sf))["walks"]


@query(f"""WITH {A.FRAGMENTS} SELECT walk, step, idx AS node, s AS start, s + len AS end, greatest(1200 - s, 0) AS off_start, least(1700 - s, len) AS off_end
FROM fr JOIN gn USING (node) WHERE sample LIKE '%u1%' AND s < 1700 AND s + len > 1200""")
def coord2node(spark, sf):
    """Fragments lie on their contig: a region is looked up from where each starts."""
    return P.coord2node(P.bundle(spark, A.graph_text(spark, sf)), "chr1:1201-1700", ("u1",)).select("walk", "step", "node", "start", "end", "off_start", "off_end")


@query(f"""WITH {A.FRAGMENTS} SELECT walk, CAST(sum(least(1700 - s, len) - greatest(1200 - s, 0)) AS BIGINT) AS bases, round(sum(least(1700 - s, len) - greatest(1200 - s, 0)) / 500, 9) AS ratio
FROM fr WHERE s < 1700 AND s + len > 1200 GROUP BY walk""")
def extracted_ratio(spark, sf):
    """How much of a region each walk over it holds."""
    return P.extracted_ratio(P.bundle(spark, A.graph_text(spark, sf)), "chr1:1201-1700", ("",)).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {A.FRAGMENTS} SELECT walk, idx AS node, s AS start, s + len - 1 AS last FROM fr JOIN gn USING (node) WHERE idx % 7 = 3 AND sample LIKE '%u2%'")
def node2coord(spark, sf):
    parts = P.bundle(spark, A.graph_text(spark, sf))
    return P.node2coord(parts, parts["nodes"].where(F.col("node") % 7 == 3).select("node"), ("u2",))


@query(f"WITH {A.BIP} SELECT src, dst, count(*) AS n FROM e WHERE src BETWEEN 3 AND 60 AND dst > 1000050 GROUP BY 1, 2")
def edge_files(spark, sf):
    """Binary edge files written by the executors and read in byte ranges, bounds on both ends applied while reading."""
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    sinks.edge_files(A.bipartite(spark, sf), path)
    return tables.edge_list(spark, path).where("src between 3 and 60 and dst > 1000050").groupBy("src", "dst").agg(F.count("*").alias("n"))


TURNED = A.WALKS + """, l AS (SELECT walk, max(step) AS last FROM w GROUP BY 1),
b AS (SELECT walk, false AS rev, step, node * 2 + CASE WHEN fwd THEN 0 ELSE 1 END AS o FROM w UNION ALL
SELECT w.walk, true, last - step, node * 2 + CASE WHEN fwd THEN 1 ELSE 0 END FROM w JOIN l ON l.walk = w.walk)"""


def turned(spark, sf):
    """Both directions of E-seq as walks over oriented nodes: walk (with its direction), step, node."""
    return graph.both_directions(A.walks(spark, sf)).select("walk", "step", S.oriented(F.col("node"), F.col("fwd")).alias("node"))


@query(f"""WITH {TURNED}, p AS (SELECT walk, rev, step, o, lead(o) OVER t AS nxt, list_reverse(list(o) OVER (PARTITION BY walk, rev ORDER BY step)) AS past FROM b WINDOW t AS (PARTITION BY walk, rev ORDER BY step)),
q AS (SELECT o, nxt, row_number() OVER (ORDER BY past, walk, rev) AS pos FROM p),
r AS (SELECT o, nxt, pos, pos - row_number() OVER (PARTITION BY o, nxt ORDER BY pos) AS g FROM q),
s AS (SELECT o, nxt, min(pos) AS start, count(*) AS length FROM r GROUP BY o, nxt, g)
SELECT o AS node, row_number() OVER (PARTITION BY o ORDER BY start) - 1 AS run, nxt AS next, length FROM s""")
def transition_runs(spark, sf):
    """The runs of each node's transitions in the order of pasts, numbered from 0 at each node."""
    moves = stored(haplotypes.runs(haplotypes.ordered(turned(spark, sf))))
    from ..operators.index import with_rank

    placed = with_rank(moves.select("node", "next", "start", "length"), "start", name="run")
    first = placed.groupBy("node").agg(F.min("run").alias("first"))
    return placed.join(first, "node").select("node", (F.col("run") - F.col("first")).alias("run"), "next", "length")


@query(f"""WITH {TURNED}, t AS (SELECT walk, rev, o AS a, lead(o, 1) OVER s AS b, lead(o, 2) OVER s AS c FROM b WINDOW s AS (PARTITION BY walk, rev ORDER BY step)),
q AS (SELECT DISTINCT a, b, c FROM t WHERE NOT rev AND c IS NOT NULL)
SELECT a, b, c, count(*) AS hits, count(DISTINCT (walk, rev)) AS walks FROM t JOIN q USING (a, b, c) GROUP BY a, b, c""")
def walks_with(spark, sf):
    """Every three steps of a walk as a pattern, looked up in all walks and their reverses."""
    steps = stored(turned(spark, sf))
    order = haplotypes.ordered(steps)
    pairs = graph.step_pairs(steps.where("not walk.reverse").withColumn("fwd", F.lit(True))).select("walk", "step", "src", "dst")
    after = pairs.select("walk", (F.col("step") - 1).alias("step"), F.col("dst").alias("third"))
    triples = stored(pairs.hint("merge").join(after, ["walk", "step"]).select(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("third").alias("c")).alias("pattern")).distinct())
    patterns = triples.select("pattern", F.posexplode(F.array("pattern.a", "pattern.b", "pattern.c")).alias("at", "node"))
    found = haplotypes.walks_with(order, haplotypes.runs(order), patterns)
    return found.select("pattern.a", "pattern.b", "pattern.c", "hits", "walks")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT n, max(p) AS p FROM n, range(0, 12) AS t(p) WHERE n % pow(10, p)::BIGINT = 0 GROUP BY n),
m AS (SELECT p, n // pow(10, p)::BIGINT AS m FROM d),
v AS (SELECT DISTINCT round(10 * a.range + 2 - 2 * cos(2 * pi() * j.range / m), 6) AS eigenvalue FROM m, range(13) AS a, range(100000) AS j WHERE a.range <= p AND j.range < m)
SELECT row_number() OVER (ORDER BY eigenvalue) - 1 AS k, eigenvalue + 0.0 AS eigenvalue FROM v ORDER BY eigenvalue LIMIT 5""")
def lowest_eigenvalues(spark, sf):
    """A ring of cliques over all customers, whose eigenvalues have a closed form, by a Krylov space over tables."""
    from ..operators.index import contiguous_index

    ids = stored(contiguous_index(A.table(spark, sf, "customer").select("c_custkey")).select(F.col("idx").alias("id")))
    n, digits = ids.count(), 0
    while n and n % 10 ** (digits + 1) == 0:
        digits += 1
    # an id is a few bytes and gives many edges, so ids are dealt by number and not by size
    coo = graph.laplacian(generators.digit_ring(ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), digits))
    values, _ = krylov.lowest(coo, 5)
    return values.select("k", (F.round("eigenvalue", 6) + 0.0).alias("eigenvalue"))


@query(f"WITH {A.FRAGMENTS} SELECT idx AS node, count(*) AS visits, count(DISTINCT walk) AS walks, CAST(sum(len) AS BIGINT) AS bases FROM fr JOIN gn USING (node) GROUP BY 1")
def bundle_visits(spark, sf):
    """Graph text to laid-out tables and back: what is walked of each node, without an exchange of steps."""
    parts = P.resolve(spark, A.graph_text(spark, sf), f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}")
    met = parts["visits"].join(parts["nodes"].select("node", F.col("len").alias("own")), "node")
    return met.groupBy("node").agg(F.count("*").alias("visits"), F.countDistinct("walk").alias("walks"), F.sum("own").alias("bases"))


@query(f"""WITH {A.OFFSETS}, t AS (SELECT user_id AS walk, CAST(floor(value * 10) AS BIGINT) AS target FROM events GROUP BY 1, 2)
SELECT t.walk, target, step, node, fwd, target - s AS offset FROM t JOIN o ON o.walk = t.walk AND s <= target AND e > target""")
def stored_places(spark, sf):
    """Places along walks looked up in a stored index: the steps that hold them."""
    path = f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}"
    position_index.write(A.walks(spark, sf), path)
    targets = A.table(spark, sf, "events").select(F.col("user_id").alias("walk"), F.floor(F.col("value") * 10).cast("bigint").alias("target")).distinct()
    return position_index.PositionIndex(spark, path).at(targets)


@query("""WITH c AS (SELECT c_nationkey * 1000000 + c_custkey // 1000 AS win, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_acctbal, c_custkey) AS p,
  row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey, c_custkey // 1000) AS m FROM customer),
b AS (SELECT x.win, x.m, max(abs(x.r - y.r)) AS before FROM c x JOIN c y ON y.win = x.win AND y.p = x.p % x.m + 1 WHERE x.m >= 3 GROUP BY 1, 2)
SELECT win, m AS nodes, before, 2::BIGINT AS after, k, round(CASE WHEN k = 0 THEN 0 ELSE 2 - 2 * cos(2 * pi() / m) END, 7) + 0.0 AS eigenvalue FROM b, range(3) AS t(k)""")
def banded_rings(spark, sf):
    """Rings of customers by balance, in blocks of a nation and a thousand keys: bandwidths before and after, and the
    three lowest eigenvalues, the second of which occurs twice."""
    of_block = Window.partitionBy("win")
    c = A.table(spark, sf, "customer").select((F.col("c_nationkey").cast("bigint") * 1000000 + F.floor(F.col("c_custkey") / 1000)).alias("win"), F.col("c_custkey").cast("bigint").alias("src"), "c_acctbal")
    order = of_block.orderBy("c_acctbal", "src")
    first = F.first("src").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rings = c.select("win", "src", F.coalesce(F.lead("src").over(order), first).alias("dst"), F.count("*").over(of_block).alias("m")).where("m >= 3")
    coo = graph.laplacian(rings.select("win", "src", "dst"), loops="skip", multi="drop", by=["win"])
    return banded.banded(coo, "win", 3).withColumn("eigenvalue", F.abs(F.round("eigenvalue", 7)) + 0.0)


@query(f"WITH {A.WALKS} SELECT CAST(node AS VARCHAR) AS name, repeat('A', max(len)::INTEGER) AS seq FROM w GROUP BY node HAVING bool_or(NOT fwd)")
def keyed_sequences(spark, sf):
    """Sequences of the nodes that some walk turns, read from their places in graph text."""
    path = A.graph_text(spark, sf)
    at = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    keyed_text.write_index(spark, path, at)
    wanted = A.walks(spark, sf).where("not fwd").select(F.col("node").cast("string").alias("name"))
    return keyed_text.sequences_of(spark, path, at, wanted)


@query("""WITH l AS (SELECT o_orderkey AS o, o_custkey * 37 % 340 - 10 AS x0, o_orderkey * 11 % 260 - 10 AS y0, o_orderkey * 29 % 340 - 10 AS x1, o_custkey * 17 % 260 - 10 AS y1, o_custkey % 256 AS r, o_orderkey % 256 AS g, (o_orderkey + o_custkey) % 256 AS b FROM orders),
s AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM l), i AS (SELECT *, unnest(range(0, n + 1)) AS i FROM s),
lp AS (SELECT o, x0 + sign(x1 - x0)::BIGINT * CASE WHEN n = 0 THEN 0 ELSE (2 * i * abs(x1 - x0) + n) // (2 * n) END AS x, y0 + sign(y1 - y0)::BIGINT * CASE WHEN n = 0 THEN 0 ELSE (2 * i * abs(y1 - y0) + n) // (2 * n) END AS y, r, g, b FROM i),
lo AS (SELECT x, y, max_by((r, g, b), o) AS c FROM lp WHERE x BETWEEN 0 AND 319 AND y BETWEEN 0 AND 239 GROUP BY 1, 2),
k AS (SELECT c_custkey * 53 % 320 AS cx, c_custkey * 31 % 240 AS cy, 6 + c_custkey % 7 AS rad, c_custkey % 100 AS r, c_custkey % 90 AS g, c_custkey % 80 AS b FROM customer),
ga AS (SELECT cx + dx AS x, cy + dy AS y, r, g, b, 1 - sqrt(dx * dx + dy * dy) / rad AS a FROM k, (SELECT range AS dx FROM range(-12, 13)), (SELECT range AS dy FROM range(-12, 13)) WHERE dx * dx + dy * dy <= rad * rad),
gl AS (SELECT x, y, sum(floor(r * a * a)) AS r, sum(floor(g * a * a)) AS g, sum(floor(b * a * a)) AS b FROM ga WHERE x BETWEEN 0 AND 319 AND y BETWEEN 0 AND 239 GROUP BY 1, 2),
d AS (SELECT s_suppkey AS o, s_suppkey * 71 % 320 AS cx, s_suppkey * 43 % 240 AS cy, 2 + s_suppkey % 4 AS rad FROM supplier),
tp AS (SELECT cx + dx AS x, cy + dy AS y, max(o) AS o FROM d, (SELECT range AS dx FROM range(-5, 6)), (SELECT range AS dy FROM range(-5, 6)) WHERE dx * dx + dy * dy <= rad * rad AND cx + dx BETWEEN 0 AND 319 AND cy + dy BETWEEN 0 AND 239 GROUP BY 1, 2),
m AS (SELECT coalesce(tp.x, lo.x, gl.x) AS x, coalesce(tp.y, lo.y, gl.y) AS y, tp.o, lo.c, gl.r, gl.g, gl.b FROM lo FULL JOIN gl ON gl.x = lo.x AND gl.y = lo.y FULL JOIN tp ON tp.x = coalesce(lo.x, gl.x) AND tp.y = coalesce(lo.y, gl.y))
SELECT x, y, CASE WHEN o IS NOT NULL THEN o % 256 ELSE least(coalesce(c[1], 0) + coalesce(r, 0), 255)::BIGINT END AS r, CASE WHEN o IS NOT NULL THEN o * 7 % 256 ELSE least(coalesce(c[2], 0) + coalesce(g, 0), 255)::BIGINT END AS g,
  CASE WHEN o IS NOT NULL THEN o * 13 % 256 ELSE least(coalesce(c[3], 0) + coalesce(b, 0), 255)::BIGINT END AS b FROM m""")
def drawn_pixels(spark, sf):
    """Orders as lines, customers as glows and suppliers as discs on one canvas."""
    o, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    k = F.col("c_custkey")
    lines = A.table(spark, sf, "orders").select(o.alias("order"), (c * 37 % 340 - 10).alias("x0"), (o * 11 % 260 - 10).alias("y0"), (o * 29 % 340 - 10).alias("x1"), (c * 17 % 260 - 10).alias("y1"), (c % 256).alias("r"), (o % 256).alias("g"), ((o + c) % 256).alias("b"))
    glows = A.table(spark, sf, "customer").select((k * 53 % 320).alias("x"), (k * 31 % 240).alias("y"), (6 + k % 7).alias("radius"), (k % 100).alias("r"), (k % 90).alias("g"), (k % 80).alias("b"))
    discs = A.table(spark, sf, "supplier").select(s.alias("order"), (s * 71 % 320).alias("x"), (s * 43 % 240).alias("y"), (2 + s % 4).alias("radius"), (s % 256).alias("r"), (s * 7 % 256).alias("g"), (s * 13 % 256).alias("b"))
    return raster.drawn(lines, glows, discs, 320, 240)


@query()
def force_layout(spark, sf):
    """Suppliers and parts, joined by lineitems, laid out by five steps of forces from scattered places."""
    edges = A.bipartite(spark, sf)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return layout.laid_out(layout.scattered(nodes), edges, iterations=5)
