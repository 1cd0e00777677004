"""The query registry: for each operator a query over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alleles, coords, generators, graph, index, intervals, matrices, sequence, snarls, spectral, windows
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Edges and indices


@query(f"WITH {A.BIP}, n AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT unnest([src, dst]) AS id FROM e)) SELECT a.idx AS src, b.idx AS dst, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY 1, 2")
def edge_index(spark, sf):
    e = A.bipartite(spark, sf)
    idx = index.node_index(graph.ends(e).select("node"))
    return index.index_edges(e, idx).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, p_partkey - min(p_partkey) OVER () AS idx FROM part")
def contiguous_index(spark, sf):
    return index.contiguous_index(A.table(spark, sf, "part").select("p_partkey"))


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT p_type AS name FROM part)")
def name_index(spark, sf):
    return index.node_index(A.table(spark, sf, "part").select("p_type"))


@query(f"WITH {A.EDGES} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")
def edge_canonical_distinct(spark, sf):
    return graph.distinct_edges(A.walk_edges(spark, sf))


@query(f"WITH {A.WALKS} SELECT walk, step, node AS src, nxt AS dst FROM (SELECT *, lead(node) OVER (PARTITION BY walk ORDER BY step) AS nxt FROM w) WHERE nxt IS NOT NULL")
def walk_bigrams(spark, sf):
    return graph.step_pairs(A.walks(spark, sf)).select("walk", "step", "src", "dst")


@query(f"""WITH {A.WALKS}, l AS (SELECT walk, max(step) AS last FROM w GROUP BY 1),
b AS (SELECT walk, false AS rev, step, node, fwd FROM w UNION ALL SELECT w.walk, true, last - step, node, NOT fwd FROM w JOIN l ON l.walk = w.walk),
t AS (SELECT node * 2 + CASE WHEN fwd THEN 0 ELSE 1 END AS from_node, lead(node * 2 + CASE WHEN fwd THEN 0 ELSE 1 END) OVER (PARTITION BY walk, rev ORDER BY step) AS to_node FROM b)
SELECT from_node, to_node, count(*) AS n FROM t WHERE to_node IS NOT NULL GROUP BY 1, 2""")
def transition_counts(spark, sf):
    return graph.transitions(A.walks(spark, sf))


@query(f"""WITH {A.WALKS}, l AS (SELECT walk, max(step) AS last FROM w GROUP BY 1)
SELECT walk, false AS reverse, step, node * 2 + CASE WHEN fwd THEN 0 ELSE 1 END AS oriented FROM w UNION ALL
SELECT w.walk, true, last - step, node * 2 + CASE WHEN fwd THEN 1 ELSE 0 END FROM w JOIN l ON l.walk = w.walk""")
def reverse_walk_union(spark, sf):
    return graph.both_directions(A.walks(spark, sf)).select("walk.walk", "walk.reverse", "step", S.oriented(F.col("node"), F.col("fwd")).alias("oriented"))


@query(f"WITH {A.EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS edge_rank FROM b")
def edge_rank_prefix(spark, sf):
    from pyspark.sql import Window

    both = graph.adjacency(A.walk_edges(spark, sf)).select(F.col("row").alias("src"), F.col("col").alias("dst"))
    return both.withColumn("edge_rank", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("bigint"))


@query(f"WITH {A.BIP} SELECT id AS node, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def node_degree(spark, sf):
    return graph.degrees(A.bipartite(spark, sf))


@query(f"WITH {A.EDGES} SELECT DISTINCT row, col, 1::BIGINT AS value FROM (SELECT src AS row, dst AS col FROM e UNION ALL SELECT dst, src FROM e)")
def adjacency_binary(spark, sf):
    return graph.adjacency(A.walk_edges(spark, sf))


@query(f"WITH {A.EDGES} SELECT src, dst, count(*) AS n FROM e WHERE src BETWEEN 10 AND 40 AND dst BETWEEN 10 AND 40 GROUP BY 1, 2")
def range_subgraph(spark, sf):
    return graph.in_range(A.walk_edges(spark, sf), 10, 40).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {A.EDGES}, k AS (SELECT DISTINCT node FROM w WHERE NOT fwd) SELECT src, dst, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM k WHERE node = src) AND EXISTS (SELECT 1 FROM k WHERE node = dst) GROUP BY 1, 2")
def subgraph_semi_join(spark, sf):
    w = A.walks(spark, sf)
    return graph.within(A.walk_edges(spark, sf), w.where("not fwd").select("node")).groupBy("src", "dst").agg(F.count("*").alias("n"))


FOUR = "SELECT src AS row, src AS col, 1 AS v FROM {t} UNION ALL SELECT dst, dst, 1 FROM {t} UNION ALL SELECT src, dst, -1 FROM {t} UNION ALL SELECT dst, src, -1 FROM {t}"


@query(f"WITH {A.EDGES} SELECT row, col, CAST(sum(v) AS BIGINT) AS value FROM (SELECT src AS row, src AS col, 1 AS v FROM e UNION ALL SELECT dst, dst, 1 FROM e UNION ALL SELECT src, dst, -1 FROM e WHERE src <> dst UNION ALL SELECT dst, src, -1 FROM e WHERE src <> dst) GROUP BY 1, 2 HAVING sum(v) <> 0")
def laplacian_dense_coo(spark, sf):
    return graph.laplacian(A.walk_edges(spark, sf), loops="degree")


@query(f"WITH {A.BIP} SELECT row, col, CAST(sum(v) AS BIGINT) AS value FROM ({FOUR.format(t='e')}) GROUP BY 1, 2 HAVING sum(v) <> 0")
def laplacian_sparse_coo(spark, sf):
    return graph.laplacian(A.bipartite(spark, sf))


@query(f"WITH {A.EDGES}, u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst) SELECT row, col, CAST(sum(v) AS BIGINT) AS value FROM ({FOUR.format(t='u')}) GROUP BY 1, 2 HAVING sum(v) <> 0")
def laplacian_region(spark, sf):
    return graph.laplacian(A.walk_edges(spark, sf), loops="skip", multi="drop")


@query(f"WITH {A.EDGES}, l AS (SELECT row, col, sum(v) AS v FROM ({FOUR.format(t='e')}) GROUP BY 1, 2 HAVING sum(v) <> 0), g AS (SELECT range AS row FROM range(101)) SELECT row, CAST((SELECT count(*) FROM l WHERE l.row < g.row) AS BIGINT) AS ptr FROM g")
def laplacian_csr_rowptr(spark, sf):
    return graph.row_pointers(graph.laplacian(A.walk_edges(spark, sf)), 100)


@query(f"WITH {A.EDGES}, l AS (SELECT row, col, sum(v) AS v FROM ({FOUR.format(t='e')}) GROUP BY 1, 2), r AS (SELECT row, sum(CASE WHEN row = col THEN v ELSE 0 END) AS d, sum(abs(v)) AS s FROM l GROUP BY 1) SELECT CAST(sum(d) AS BIGINT) AS trace, greatest(CAST(max(s) AS DOUBLE), 1.0) AS bound FROM r")
def laplacian_trace_bound(spark, sf):
    return graph.trace_and_bound(graph.laplacian(A.walk_edges(spark, sf)))


SIMPLE = "u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst), b AS (SELECT src AS row, dst AS col FROM u UNION ALL SELECT dst, src FROM u), g AS (SELECT row, count(*) AS d FROM b GROUP BY 1)"


@query(f"WITH {A.EDGES}, {SIMPLE} SELECT b.row, b.col, round(-1 / sqrt(x.d * y.d), 9) AS value FROM b JOIN g x ON x.row = b.row JOIN g y ON y.row = b.col UNION ALL SELECT row, row, 1.0 FROM g")
def normalized_laplacian_coo(spark, sf):
    return graph.normalized_laplacian(A.walk_edges(spark, sf)).withColumn("value", F.round("value", 9))


@query(f"WITH {A.EDGES}, l AS (SELECT row, col, sum(v) AS v FROM ({FOUR.format(t='e')}) GROUP BY 1, 2), g AS (SELECT id AS node, count(*) AS x FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT row, CAST(sum(v) AS BIGINT) AS ones, CAST(sum(v * x) AS BIGINT) AS value FROM l JOIN g ON g.node = l.col GROUP BY 1")
def matvec_ones_degree(spark, sf):
    e = A.walk_edges(spark, sf)
    coo = graph.laplacian(e)
    deg = graph.degrees(e).withColumnRenamed("degree", "x")
    ones = graph.matvec(coo, deg.withColumn("x", F.lit(1).cast("bigint"))).withColumnRenamed("value", "ones")
    return ones.join(graph.matvec(coo, deg), "row").select("row", "ones", "value")


@query(f"WITH {A.EDGES}, l AS (SELECT row, col, sum(v) AS v FROM ({FOUR.format(t='e')}) GROUP BY 1, 2 HAVING sum(v) <> 0) SELECT count(*) AS entries, count(DISTINCT row) AS rows, max(abs(row - col)) AS bandwidth, 0::BIGINT AS asymmetric FROM l")
def bandwidth_sparsity(spark, sf):
    return graph.shape_report(graph.laplacian(A.walk_edges(spark, sf)))


# Windows


@query("""WITH l AS (SELECT max(p_partkey) AS n FROM part) SELECT range AS start, range + 40 AS "end" FROM range(0, (SELECT n - 39 FROM l), 30)
UNION SELECT n - 40, n FROM l WHERE ((n - 40) // 30 + 1) * 30 < n""")
def node_windows(spark, sf):
    return windows.node_windows(spark, 0, A.table(spark, sf, "part").agg(F.max("p_partkey")).first()[0], 40, 10)


@query('WITH l AS (SELECT 100 * count(*) + 500 AS n FROM orders) SELECT range AS start, least(range + 2000, n) AS "end" FROM range(0, (SELECT n FROM l), 2000), l')
def coordinate_windows(spark, sf):
    return windows.coordinate_windows(spark, 0, 100 * A.table(spark, sf, "orders").count() + 500, 2000)


@query("SELECT range AS start, range + 200 AS \"end\" FROM range(0, (SELECT max(l_partkey) FROM lineitem) + 1, 5)")
def sliding_ranges(spark, sf):
    return windows.sliding_ranges(spark, A.table(spark, sf, "lineitem").agg(F.max("l_partkey")).first()[0])


WINS = "n AS (SELECT s, s + 20 AS t FROM (SELECT range AS s FROM range(0, 81, 15)) UNION SELECT 80, 100)"


@query(f"WITH {A.EDGES}, {WINS} SELECT s AS win, src, dst, count(*) AS n FROM e JOIN n ON src >= s AND src < t AND dst >= s AND dst < t GROUP BY 1, 2, 3")
def window_edges(spark, sf):
    return windows.edges_in_windows(A.walk_edges(spark, sf), 0, 100, 20, 5).groupBy("win", "src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {A.EDGES}, {WINS}, u AS (SELECT DISTINCT s AS win, least(src, dst) AS src, greatest(src, dst) AS dst FROM e JOIN n ON src >= s AND src < t AND dst >= s AND dst < t) SELECT win, row, col, CAST(sum(v) AS BIGINT) AS value FROM (SELECT win, src AS row, src AS col, 1 AS v FROM u UNION ALL SELECT win, dst, dst, 1 FROM u UNION ALL SELECT win, src, dst, -1 FROM u UNION ALL SELECT win, dst, src, -1 FROM u) GROUP BY 1, 2, 3 HAVING sum(v) <> 0")
def window_laplacian(spark, sf):
    return windows.window_laplacians(A.walk_edges(spark, sf), 0, 100, 20, 5)


@query(f"WITH {A.INTERVALS}, g AS (SELECT * FROM (VALUES ('early', 0, 700), ('middle', 650, 1500), ('late', 1500, 2600)) AS t(name, lo, hi)) SELECT name, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS days FROM i JOIN g ON s < hi AND e > lo GROUP BY 1")
def gene_annotation(spark, sf):
    names = spark.createDataFrame([("early", 0, 700), ("middle", 650, 1500), ("late", 1500, 2600)], "name string, lo long, hi long")
    return windows.labelled(A.customer_intervals(spark, sf), F.broadcast(names)).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("days"))


# Spectra


#: Numbers of orders as spectra: what each line's quantity has over 3.
SPECTRA = "v AS (SELECT l_orderkey AS win, CAST(l_quantity AS DOUBLE) - 3 AS x FROM lineitem)"


@query(f"""WITH {SPECTRA}, t AS (SELECT win, min(x) AS low, count(*) AS m, sum(x) AS s, sum(CASE WHEN x > 1e-15 THEN x * ln(x) ELSE 0 END) AS e, count(*) FILTER (x >= -1e-9) AS lm, sum(x) FILTER (x > 0) AS ls FROM v GROUP BY 1)
SELECT win, CASE WHEN low >= -1e-9 AND s > 0 AND m > 1 THEN round((ln(CASE WHEN s > 0 THEN s ELSE 1 END) - e / CASE WHEN s > 0 THEN s ELSE 1 END) / ln(m), 9) + 0.0 END AS strict_score,
  CASE WHEN coalesce(ls, 0) = 0 THEN 0.0 WHEN lm <= 1 THEN -1.0 ELSE round((ln(ls) - e / ls) / ln(lm), 9) + 0.0 END AS lenient_score FROM t""")
def entropy_from_spectrum(spark, sf):
    v = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("win"), (F.col("l_quantity").cast("double") - 3).alias("eigenvalue"))
    strict = spectral.score_of_spectrum(v, "win").withColumnRenamed("score", "strict_score")
    lenient = spectral.score_of_spectrum(v, "win", strict=False).withColumnRenamed("score", "lenient_score")
    return strict.join(lenient, "win").select("win", (F.round("strict_score", 9) + 0.0).alias("strict_score"), (F.round(F.nanvl("lenient_score", F.lit(-1.0)), 9) + 0.0).alias("lenient_score"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 1e-15 THEN l_discount * ln(CASE WHEN l_discount > 0 THEN l_discount ELSE 1 END) ELSE 0 END, 9) AS y FROM lineitem")
def x_ln_x(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.x_ln_x(F.col("l_discount").cast("double")), 9).alias("y"))


@query("WITH h AS (SELECT max(l_quantity)::DOUBLE / 2 AS h FROM lineitem), t AS (SELECT (range + 0.5) * pi() / 17 AS th FROM range(17)), f AS (SELECT th, CASE WHEN (cos(th) + 1) * h > 1e-15 THEN (cos(th) + 1) * h * ln((cos(th) + 1) * h) ELSE 0 END AS y FROM t, h) SELECT CAST(k AS INTEGER) AS k, round(sum(cos(k * th) * y) * CASE WHEN k = 0 THEN 1.0 / 17 ELSE 2.0 / 17 END, 7) AS coefficient FROM f, (SELECT range AS k FROM range(17)) GROUP BY k")
def chebyshev_coefficients(spark, sf):
    top = float(A.table(spark, sf, "lineitem").agg(F.max("l_quantity")).first()[0])
    return spectral.chebyshev_table(spark, top, 16).select("k", F.round("coefficient", 7).alias("coefficient"))


@query()
def window_spectrum(spark, sf):
    return spectral.spectra(windows.window_laplacians(A.walk_edges(spark, sf), 0, 100, 20, 5), "win").withColumn("eigenvalue", F.round("eigenvalue", 6))


@query()
def entropy_exact_window(spark, sf):
    return spectral.block_scores(windows.window_laplacians(A.walk_edges(spark, sf), 0, 100, 20, 5), "win").withColumn("score", F.round("score", 6))


@query()
def entropy_hutchinson(spark, sf):
    return spectral.block_scores(windows.window_laplacians(A.walk_edges(spark, sf), 0, 100, 20, 5), "win", exact=False).withColumn("score", F.round("score", 6))


@query()
def spectral_embedding(spark, sf):
    return spectral.embedding(graph.normalized_laplacian(A.walk_edges(spark, sf))).select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Names, regions and other scalars


REGIONS = "q AS (SELECT o_orderkey AS id, 'chr' || (o_custkey % 23) || ':' || (o_orderkey % 50) || '-' || (o_custkey % 60) AS r FROM orders)"


def _regions(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 23).cast("string"), F.lit(":"), (F.col("o_orderkey") % 50).cast("string"), F.lit("-"), (F.col("o_custkey") % 60).cast("string")).alias("r"))


@query(f"WITH {REGIONS}, x AS (SELECT id, split_part(r, ':', 1) AS contig, CAST(split_part(split_part(r, ':', 2), '-', 1) AS BIGINT) AS a, CAST(split_part(r, '-', 2) AS BIGINT) AS b FROM q) SELECT id, CASE WHEN b >= a THEN contig END AS contig, CASE WHEN b >= a THEN CASE WHEN a = 0 THEN 0 ELSE a - 1 END END AS start, CASE WHEN b >= a THEN CASE WHEN a = 0 THEN b + 1 ELSE b END END AS \"end\" FROM x")
def parse_region(spark, sf):
    return _regions(spark, sf).select("id", S.region(F.col("r")).alias("g")).select("id", "g.contig", "g.start", "g.end")


@query(f"WITH {A.INTERVALS} SELECT cust, s AS start, (s + 1) || '-' || e AS text, count(*) AS n FROM i GROUP BY 1, 2, 3")
def format_region(spark, sf):
    return A.customer_intervals(spark, sf).groupBy("cust", "start", S.region_text(F.col("start"), F.col("end")).alias("text")).agg(F.count("*").alias("n"))


NAMES = "q AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'chr' || p_size WHEN 1 THEN 'grch38#chr' || p_size WHEN 2 THEN 'HG' || p_size || '#' || (p_partkey % 3) || '#chr' || (p_size % 5) || '@x' WHEN 3 THEN '#mat#ctg[' || p_size || ']' WHEN 4 THEN 'CHM13#1#JA.' || p_size || '#MT' ELSE 's#h#a#b#c' END AS name FROM part)"


def _names(spark, sf):
    p = A.table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = (
        F.when(key % 6 == 0, F.concat(F.lit("chr"), size))
        .when(key % 6 == 1, F.concat(F.lit("grch38#chr"), size))
        .when(key % 6 == 2, F.concat(F.lit("HG"), size, F.lit("#"), (key % 3).cast("string"), F.lit("#chr"), (F.col("p_size") % 5).cast("string"), F.lit("@x")))
        .when(key % 6 == 3, F.concat(F.lit("#mat#ctg["), size, F.lit("]")))
        .when(key % 6 == 4, F.concat(F.lit("CHM13#1#JA."), size, F.lit("#MT")))
        .otherwise("s#h#a#b#c")
    )
    return p.select(key.alias("id"), name.alias("name"))


@query(f"WITH {NAMES} SELECT id, split_part(regexp_extract(name, '[^#]*$'), '@', 1) AS plain FROM q")
def normalize_contig(spark, sf):
    return _names(spark, sf).select("id", S.plain_contig(F.col("name")).alias("plain"))


@query(f"WITH {NAMES} SELECT id, split_part(name, '[', 1) AS stripped, replace(replace(name, '#', '_'), '/', '_') AS file FROM q")
def strip_suffix(spark, sf):
    return _names(spark, sf).select("id", S.without_fragment(F.col("name")).alias("stripped"), S.file_safe(F.col("name")).alias("file"))


@query(f"WITH {NAMES}, x AS (SELECT id, name, split_part(regexp_extract(name, '[^#]*$'), '@', 1) AS n FROM q) SELECT id, name = 'chr3' OR n = 'chr3' AS same, name LIKE 'CHM13#%' AS of_sample, contains(lower(name), 't2t') OR contains(lower(name), 'chm13') AS of_assembly FROM x")
def contig_match(spark, sf):
    n = F.col("name")
    return _names(spark, sf).select("id", S.contig_matches(n, F.lit("chr3")).alias("same"), S.of_sample(n, F.lit("CHM13")).alias("of_sample"), S.assembly_matches(n, "t2t").alias("of_assembly"))


@query(f"""WITH {NAMES}, x AS (SELECT id, name, string_split(name, '#') AS p FROM q), y AS (SELECT *, len(p) - 1 AS n, CASE WHEN p[1] = '' THEN 'unknown' ELSE p[1] END AS s, len(p) > 1 AND regexp_full_match(p[2], '[0-9]+') AS num FROM x)
SELECT id, CASE WHEN n = 1 THEN s || '#0#' || CASE WHEN p[2] = '' THEN 'unknown' ELSE p[2] END WHEN n = 2 AND NOT num THEN s || '#0#' || CASE WHEN p[3] = '' THEN 'unknown' ELSE p[3] END
WHEN n >= 3 THEN s || '#' || CASE WHEN num THEN p[2] ELSE '0' END || '#' || array_to_string(p[3:], '_') ELSE name END AS fixed,
CASE WHEN n = 1 AND regexp_matches(name, '^(chm13|grch38)#chr') THEN 'reference' WHEN n = 1 THEN 'missing_haplotype' WHEN n = 2 AND NOT num THEN 'haplotype' WHEN n > 2 THEN 'complex' ELSE 'none' END AS repair FROM y""")
def three_field_names(spark, sf):
    return _names(spark, sf).select("id", S.three_field_name(F.col("name")).alias("fixed"), S.name_repair(F.col("name")).alias("repair"))


U32 = "q AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_orderkey % 5 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_partkey * 9999991 AS VARCHAR) WHEN 2 THEN ' ' || l_partkey WHEN 3 THEN '' ELSE 's' || l_partkey END AS t FROM lineitem)"


@query(f"WITH {U32} SELECT id, line, CASE WHEN regexp_full_match(t, '[0-9]+') AND CAST(t AS HUGEINT) <= 4294967295 THEN CAST(t AS BIGINT) END AS number, trim(t) AS trimmed FROM (SELECT id, line, CASE WHEN regexp_full_match(t, '[0-9]+') THEN t ELSE t END AS t FROM q)".replace("CAST(t AS HUGEINT)", "TRY_CAST(t AS HUGEINT)").replace("CAST(t AS BIGINT) END", "TRY_CAST(t AS BIGINT) END"))
def strict_u32(spark, sf):
    part, kind = F.col("l_partkey"), F.col("l_orderkey") % 5
    text = F.when(kind == 0, part.cast("string")).when(kind == 1, (part * 9999991).cast("string")).when(kind == 2, F.concat(F.lit(" "), part.cast("string"))).when(kind == 3, "").otherwise(F.concat(F.lit("s"), part.cast("string")))
    q = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), text.alias("t"))
    return q.select("id", "line", S.strict_u32(F.col("t")).alias("number"), S.ascii_trim(F.col("t")).alias("trimmed"))


# Sequences


@query(f"WITH {A.DNA} SELECT node, translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') AS rc FROM d")
def reverse_complement(spark, sf):
    return A.dna(spark, sf).select("node", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {A.DNA} SELECT node, substring(CASE WHEN node % 2 = 0 THEN seq ELSE translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') END, 3, 5) AS piece FROM d")
def oriented_slice(spark, sf):
    return A.dna(spark, sf).select("node", S.oriented_slice(F.col("seq"), F.col("node") % 2 == 0, F.lit(2), F.lit(7)).alias("piece"))


@query("WITH t AS (SELECT doc_id AS name, text AS seq FROM documents), k AS (SELECT name, seq, unnest(range(0, greatest(length(seq), 1), 1024)) AS p FROM t) SELECT name, CAST(p // 1024 AS INTEGER) AS chunk, length(substring(seq, p + 1, 1024)) AS n, md5(substring(seq, p + 1, 1024)) AS digest FROM k")
def sequence_chunks(spark, sf):
    t = A.table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"))
    return sequence.chunked(t).select("name", "chunk", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


@query("SELECT p_partkey AS node, regexp_replace(regexp_replace(s, '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS record FROM (SELECT p_partkey, repeat(translate(p_name, ' ', 'N'), 5) AS s FROM part)")
def fasta_wrap(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.repeat(F.translate("p_name", " ", "N"), 5).alias("s"))
    return p.select("node", S.wrapped(F.col("s")).alias("record"))


@query(f"WITH {A.DNA}, n AS (SELECT l_partkey AS node, 1 + max(l_linenumber) AS len FROM lineitem GROUP BY 1), a AS (SELECT * FROM d WHERE node % 3 = 0), b AS (SELECT node, reverse(seq) AS seq FROM d WHERE node % 3 < 2) SELECT n.node, CAST(n.len AS BIGINT) AS len, coalesce(a.seq, b.seq, repeat('N', n.len)) AS seq FROM n LEFT JOIN a ON a.node = n.node LEFT JOIN b ON b.node = n.node")
def n_padding_fallback(spark, sf):
    nodes = A.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg((F.max("l_linenumber") + 1).cast("bigint").alias("len"))
    d = A.dna(spark, sf)
    return sequence.with_fallback(nodes, d.where("node % 3 = 0"), d.where("node % 3 < 2").withColumn("seq", F.reverse("seq")))


@query(f"WITH {A.DNA} SELECT node, seq FROM d WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = node AND l_quantity > 49)")
def sequence_semi_join(spark, sf):
    return sequence.of_nodes(A.dna(spark, sf), A.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("node")))


@query(f"WITH {A.WALKS}, c AS (SELECT node AS name, unnest(range(0, 1 + node % 3)) AS chunk FROM (SELECT DISTINCT node FROM w)) SELECT walk, step, CASE WHEN fwd THEN chunk ELSE name % 3 - chunk END AS part, name * 10 + chunk AS node, fwd FROM w JOIN c ON c.name = w.node")
def segment_chunk_expand(spark, sf):
    w = A.walks(spark, sf)
    chunk_index = w.select(F.col("node").alias("name")).distinct().select("name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("name") % 3)).alias("chunk")).withColumn("node", F.col("name") * 10 + F.col("chunk"))
    return sequence.expanded_steps(w.withColumnRenamed("node", "name").drop("len"), chunk_index)


@query(f"""WITH {A.OFFSETS}, q AS (SELECT walk, step, fwd, substring('ACGTTGCA', CAST(1 + node % 2 AS INTEGER), CAST(len AS INTEGER)) AS seq, greatest(20 - s, 0) AS a, least(80, e) - s AS b FROM o WHERE s < 80 AND e > 20)
SELECT walk, string_agg(substring(CASE WHEN fwd THEN seq ELSE translate(reverse(seq), 'ACGT', 'TGCA') END, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER)), '' ORDER BY step) AS seq FROM q GROUP BY 1""")
def assembled_regions(spark, sf):
    hits = coords.overlaps(A.walks(spark, sf), 20, 80)
    seqs = A.walks(spark, sf).select("node", "len").distinct().select("node", F.expr("substring('ACGTTGCA', 1 + int(node % 2), int(len))").alias("seq"))
    return sequence.assembled(hits, seqs)


# Coordinates


@query(f"WITH {A.OFFSETS} SELECT walk, step, node, s AS start, e AS \"end\" FROM o")
def path_offsets(spark, sf):
    return coords.offsets(A.walks(spark, sf)).select("walk", "step", "node", "start", "end")


@query(f"WITH {A.WALKS} SELECT walk, CAST(sum(len) AS BIGINT) AS length, count(*) AS steps, count(DISTINCT node) AS nodes FROM w GROUP BY 1")
def path_length(spark, sf):
    return coords.lengths(A.walks(spark, sf))


@query(f"WITH {A.OFFSETS} SELECT walk, node, s AS start, e - 1 AS last FROM o WHERE node IN (3, 17, 42, 99)")
def node_to_coord(spark, sf):
    nodes = spark.createDataFrame([(3,), (17,), (42,), (99,)], "node long")
    return coords.node_to_coordinates(A.walks(spark, sf), nodes)


@query(f"WITH {A.OFFSETS} SELECT walk, step, node, fwd, CAST(greatest(25 - s, 0) AS BIGINT) AS off_start, CAST(least(110, e) - s AS BIGINT) AS off_end FROM o WHERE s < 110 AND e > 25")
def coord_overlap(spark, sf):
    return coords.overlaps(A.walks(spark, sf), 25, 110).select("walk", "step", "node", "fwd", F.col("off_start").cast("bigint").alias("off_start"), "off_end")


ASKED = "q AS (SELECT o_orderkey AS region, o_custkey % 150 AS walk, o_orderkey % 300 AS lo, o_orderkey % 300 + 1 + o_custkey % 40 AS hi FROM orders)"


@query(f"WITH {A.OFFSETS}, {ASKED} SELECT region, o.walk, step, node, greatest(lo - s, 0) AS off_start, least(hi, e) - s AS off_end FROM o JOIN q ON q.walk = o.walk AND s < hi AND e > lo")
def region_range_join(spark, sf):
    q = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("region"), (F.col("o_custkey") % 150).alias("walk"), (F.col("o_orderkey") % 300).alias("lo"), (F.col("o_orderkey") % 300 + 1 + F.col("o_custkey") % 40).alias("hi"))
    return coords.region_overlaps(A.walks(spark, sf), q).select("region", "walk", "step", "node", "off_start", "off_end")


FIRST_LAST = "h AS (SELECT *, greatest(30 - s, 0) AS a, least(90, e) - s AS b FROM o WHERE s < 90 AND e > 30)"


@query(f"WITH {A.OFFSETS}, {FIRST_LAST} SELECT walk, min_by(node, step) AS first_node, CAST(min_by(a, step) AS BIGINT) AS first_start, max_by(node, step) AS last_node, max_by(b, step) AS last_end FROM h GROUP BY 1")
def anchor_first_last(spark, sf):
    a = coords.anchors(A.walks(spark, sf), 30, 90)
    return a.select("walk", F.col("first.node").alias("first_node"), F.col("first.off_start").cast("bigint").alias("first_start"), F.col("last.node").alias("last_node"), F.col("last.off_end").alias("last_end"))


@query(f"WITH {A.OFFSETS}, {FIRST_LAST} SELECT walk, step, CAST(CASE WHEN fwd THEN least(a, len) ELSE len - least(b, len) END AS BIGINT) AS fwd_start, CAST(CASE WHEN fwd THEN least(b, len) ELSE len - least(a, len) END AS BIGINT) AS fwd_end FROM h")
def anchor_offsets(spark, sf):
    return coords.forward_offsets(coords.overlaps(A.walks(spark, sf), 30, 90)).select("walk", "step", F.col("fwd_start").cast("bigint").alias("fwd_start"), F.col("fwd_end").cast("bigint").alias("fwd_end"))


@query(f"""WITH {A.WALKS}, f AS (SELECT walk, min(step) AS f FROM w WHERE node = 10 GROUP BY 1), z AS (SELECT w.walk, min(f) AS f, min(step) AS z FROM w JOIN f ON f.walk = w.walk WHERE node = 20 AND step >= f GROUP BY 1)
SELECT w.walk, w.step, w.node, w.fwd FROM w JOIN z ON z.walk = w.walk AND w.step BETWEEN f AND z""")
def anchor_collect(spark, sf):
    return coords.between_anchors(A.walks(spark, sf), 10, 20)


#: Walks leave the reach at nodes of a residue; a stretch is the first from 10 to 20 without such a step between.
@query(f"""WITH {A.WALKS}, i AS (SELECT * FROM w WHERE node % 23 <> 5), o AS (SELECT walk, step FROM w WHERE node % 23 = 5),
c AS (SELECT a.walk, a.step AS f, b.step AS z FROM i a JOIN i b ON b.walk = a.walk AND b.step >= a.step WHERE a.node = 10 AND b.node = 20),
g AS (SELECT walk, f, z FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.walk = c.walk AND o.step BETWEEN c.f AND c.z)),
s AS (SELECT walk, min(z) AS z FROM g GROUP BY 1), b AS (SELECT g.walk, min(f) AS f, s.z FROM g JOIN s ON s.walk = g.walk AND s.z = g.z GROUP BY 1, 3)
SELECT w.walk, w.step, w.node, w.fwd FROM w JOIN b ON b.walk = w.walk AND w.step BETWEEN f AND z""")
def anchor_collect_within_reach(spark, sf):
    w = A.walks(spark, sf)
    return coords.between_anchors(w, 10, 20, w.where("node % 23 <> 5").select("node"))


@query(f"WITH {A.OFFSETS}, k AS (SELECT walk, step, s FROM o WHERE step % 10 = 0), q AS (SELECT DISTINCT walk, t AS target FROM w, (SELECT unnest([5, 60, 111, 190]) AS t)) SELECT q.walk, CAST(q.target AS BIGINT) AS target, k.step, k.s AS start FROM q ASOF LEFT JOIN k ON q.walk = k.walk AND q.target >= k.s")
def sampled_seek(spark, sf):
    w = A.walks(spark, sf)
    asked = w.select("walk").distinct().select("walk", F.explode(F.array(*[F.lit(t).cast("bigint") for t in (5, 60, 111, 190)])).alias("target"))
    return coords.seek(w, asked)


@query(f"WITH {A.WALKS}, n AS (SELECT DISTINCT walk, 's' || (walk % 4) || '#1#chr' || (walk % 3) AS name FROM w), t AS (SELECT walk, CASE WHEN name LIKE '%#chr1' THEN 0 ELSE 1 END AS tier FROM n WHERE name LIKE 's2#%' AND walk IN (SELECT walk FROM w WHERE node = 7)) SELECT walk, tier FROM t WHERE tier = (SELECT min(tier) FROM t)")
def candidate_paths(spark, sf):
    w = A.walks(spark, sf)
    names = w.select("walk").distinct().select("walk", F.concat(F.lit("s"), (F.col("walk") % 4).cast("string"), F.lit("#1#chr"), (F.col("walk") % 3).cast("string")).alias("name"))
    return coords.candidate_walks(w, names, 7, "s2", "chr1")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT p_partkey % 97 AS a, (p_partkey * 7 + 3) % 97 AS b FROM part)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 0::BIGINT AS node, 0::BIGINT AS cost UNION SELECT g.b, r.cost + 1 + g.a % 7 FROM r JOIN g ON g.a = r.node WHERE r.cost + 1 + g.a % 7 <= 14)
SELECT node, min(cost) AS cost FROM r GROUP BY 1""")
def bounded_bfs(spark, sf):
    p = A.table(spark, sf, "part")
    e = p.select((F.col("p_partkey") % 97).alias("src"), ((F.col("p_partkey") * 7 + 3) % 97).alias("dst")).distinct()
    lens = spark.range(97).select(F.col("id").alias("node"), (1 + F.col("id") % 7).alias("len"))
    return coords.bounded_reach(e, lens, spark.range(1).select(F.col("id").alias("node")), 14)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 97 AS a, p_partkey % 3 > 0 AS af, (p_partkey * 7 + 3) % 97 AS b, p_partkey % 5 > 0 AS bf FROM part),
g AS (SELECT a, af, b, bf FROM e UNION SELECT b, NOT bf, a, NOT af FROM e),
r AS (SELECT 1::BIGINT AS node, f AS fwd, 0::BIGINT AS cost FROM (SELECT unnest([true, false]) AS f)
  UNION SELECT g.b, g.bf, r.cost + g.a % 7 FROM r JOIN g ON g.a = r.node AND g.af = r.fwd WHERE r.cost + g.a % 7 <= 9 AND g.a % 7 > 0)
SELECT node, min(cost) AS cost FROM r WHERE node % 7 > 0 GROUP BY 1""")
def oriented_bfs(spark, sf):
    a, b = F.col("p_partkey") % 97, (F.col("p_partkey") * 7 + 3) % 97
    links = A.table(spark, sf, "part").select(a.alias("src"), (F.col("p_partkey") % 3 > 0).alias("src_fwd"), b.alias("dst"), (F.col("p_partkey") % 5 > 0).alias("dst_fwd"))
    lens = spark.range(97).select(F.col("id").alias("node"), (F.col("id") % 7).alias("len"))
    return coords.oriented_reach(links, lens, spark.range(1, 2).select(F.col("id").alias("node")), 9)


@query(f"WITH {A.WALKS}, c AS (SELECT walk, step, node, count(*) OVER (PARTITION BY walk ORDER BY step) AS k, sum(len) OVER (PARTITION BY walk ORDER BY step) AS b FROM w) SELECT walk, step, node FROM c WHERE k <= 30 AND b <= 100")
def capped_walks(spark, sf):
    return coords.capped(A.walks(spark, sf), 30, 100).select("walk", "step", "node")


# Intervals


@query(f"WITH {A.MERGED} SELECT cust, s AS start, e AS \"end\" FROM m")
def merge_intervals(spark, sf):
    return intervals.merged(A.customer_intervals(spark, sf), ["cust"])


@query(f"WITH {A.MERGED} SELECT cust, string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ', ' ORDER BY s) AS ranges FROM m GROUP BY 1")
def coord_range_report(spark, sf):
    return intervals.report(A.customer_intervals(spark, sf), ["cust"])


@query(f"WITH {A.MERGED} SELECT cust, round(sum(e - s + 1) / 2500 * 100, 6) AS percent FROM m GROUP BY 1")
def nonredundant_coverage(spark, sf):
    return intervals.coverage(A.customer_intervals(spark, sf), ["cust"], 2500).withColumn("percent", F.round("percent", 6))


@query("WITH k AS (SELECT l_suppkey AS supp, l_partkey AS p, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), r AS (SELECT supp, min(p) AS a, max(p) AS b FROM k GROUP BY supp, g) SELECT supp, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1")
def node_ranges(spark, sf):
    return intervals.id_ranges(A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), "l_partkey"), ["supp"], "l_partkey")


@query(f"WITH {A.MERGED} SELECT cust, s AS start, e AS \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY e - s DESC, s) AS k FROM m) WHERE k = 1")
def longest_fragment(spark, sf):
    return intervals.longest(intervals.merged(A.customer_intervals(spark, sf), ["cust"]), ["cust"])


@query(f"WITH {A.INTERVALS}, h AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY s, e) AS hit FROM i WHERE s <= 1400 AND e >= 300) SELECT cust, s AS start, e AS \"end\", CAST(hit AS INTEGER) AS hit FROM h WHERE hit <= 2")
def first_hits_in_region(spark, sf):
    return intervals.first_hits(A.customer_intervals(spark, sf), ["cust"], 800, 900)


# Signatures, alleles and snarls


@query(f"""WITH {A.WALKS}, f AS (SELECT walk, string_agg(node || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY step) AS a, string_agg(node || CASE WHEN fwd THEN '-' ELSE '+' END, ',' ORDER BY step DESC) AS b FROM w GROUP BY 1)
SELECT walk, least(a, b) AS signature FROM f""")
def step_signature(spark, sf):
    steps = A.walks(spark, sf).groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("step", "node", "fwd"))).alias("s"))
    return steps.select("walk", S.signature(F.col("s")).alias("signature"))


@query("WITH q AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size || '+,{c7},' || p_partkey || '-' WHEN 1 THEN 'OTHER' ELSE p_partkey || '-|{3}|' || p_size || '+,9-' END AS s FROM part), x AS (SELECT id, s, unnest(regexp_split_to_array(s, '[|,]')) AS t FROM q) SELECT id, CAST(regexp_extract(t, '[0-9]+') AS BIGINT) AS node FROM x WHERE s <> 'OTHER' AND regexp_full_match(t, '[0-9]+[+-]')")
def signature_nodes(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    sig = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit("+,{c7},"), key, F.lit("-"))).when(F.col("p_partkey") % 3 == 1, "OTHER").otherwise(F.concat(key, F.lit("-|{3}|"), size, F.lit("+,9-")))
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(S.signature_nodes(sig)).alias("node"))


HITS = "h AS (SELECT walk, snarl, step, bool_or(node = entry) AS en, bool_or(node = exit) AS ex FROM w JOIN sn ON node = entry OR node = exit GROUP BY 1, 2, 3)"
CAND = """c AS (SELECT walk, snarl, step AS a, (SELECT min(step) FROM h y WHERE y.walk = h.walk AND y.snarl = h.snarl AND y.{z} AND y.step >= h.step) AS b FROM h WHERE {y}
UNION SELECT walk, snarl, (SELECT max(step) FROM h y WHERE y.walk = h.walk AND y.snarl = h.snarl AND y.{y} AND y.step <= h.step), step FROM h WHERE {z})"""
SPANS = (
    f"{A.WALKS}, {A.SNARLS}, {HITS}, "
    + CAND.format(y="en", z="ex").replace("c AS", "c1 AS", 1)
    + ", "
    + CAND.format(y="ex", z="en").replace("c AS", "c2 AS", 1)
    + """, s1 AS (SELECT walk, snarl, min((a, b)) AS p, max(a) AS last FROM c1 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), s2 AS (SELECT walk, snarl, min((a, b)) AS p, max(a) AS last FROM c2 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
k AS (SELECT walk, snarl, min(step) AS alone FROM h GROUP BY 1, 2), sp AS (SELECT k.walk, k.snarl, coalesce(s1.p[1], s2.p[1], alone) AS s, coalesce(s1.p[2], s2.p[2], alone) AS e,
CASE WHEN s1.p IS NOT NULL THEN s1.last > s1.p[2] WHEN s2.p IS NOT NULL THEN s2.last > s2.p[2] ELSE false END AS amb FROM k LEFT JOIN s1 ON s1.walk = k.walk AND s1.snarl = k.snarl LEFT JOIN s2 ON s2.walk = k.walk AND s2.snarl = k.snarl)"""
)


@query(f"WITH {SPANS} SELECT walk, snarl, s AS start, e AS \"end\", amb AS ambiguous FROM sp")
def span_resolution(spark, sf):
    return snarls.spans(snarls.boundary_hits(A.walks(spark, sf), A.snarls(spark)))


@query(f"WITH {A.WALKS}, {A.SNARLS}, {HITS} SELECT snarl, CAST(sum(CASE WHEN en THEN 1 ELSE 0 END) AS BIGINT) AS at_entry, CAST(sum(CASE WHEN ex THEN 1 ELSE 0 END) AS BIGINT) AS at_exit, count(DISTINCT walk) AS walks FROM h GROUP BY 1")
def boundary_hits(spark, sf):
    h = snarls.boundary_hits(A.walks(spark, sf), A.snarls(spark))
    return h.groupBy("snarl").agg(F.sum(F.col("at_entry").cast("bigint")).alias("at_entry"), F.sum(F.col("at_exit").cast("bigint")).alias("at_exit"), F.countDistinct("walk").alias("walks"))


FLAT = SPANS + """, g AS (SELECT sp.walk, snarl, string_agg(node || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY step) AS a, string_agg(node || CASE WHEN fwd THEN '-' ELSE '+' END, ',' ORDER BY step DESC) AS b FROM sp JOIN w ON w.walk = sp.walk AND step BETWEEN s AND e WHERE NOT amb GROUP BY 1, 2),
fl AS (SELECT walk, snarl, least(a, b) AS label FROM g UNION ALL SELECT walk, snarl, 'AMBIGUOUS_PARALOG' FROM sp WHERE amb)"""


@query(f"WITH {FLAT} SELECT walk, snarl, label FROM fl")
def flat_signature(spark, sf):
    return snarls.flat_signatures(A.walks(spark, sf), A.snarls(spark))


@query(f"WITH {FLAT}, c AS (SELECT snarl, label, count(*) AS n FROM fl GROUP BY 1, 2), p AS (SELECT snarl, CASE WHEN n >= 2 OR label = 'AMBIGUOUS_PARALOG' THEN label ELSE 'OTHER' END AS label, NOT (n >= 2 OR label = 'AMBIGUOUS_PARALOG') AS rest, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2, 3) SELECT snarl AS site, label, n, round(n / sum(n) OVER (PARTITION BY snarl), 9) AS frequency, CAST(row_number() OVER (PARTITION BY snarl ORDER BY rest, n DESC, label) - 1 AS BIGINT) AS idx FROM p")
def panel_counts(spark, sf):
    return snarls.panel(A.walks(spark, sf), A.snarls(spark))["flat"].withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {SPANS}, l AS (SELECT walk, snarl, max(step) AS last FROM h GROUP BY 1, 2), x AS (SELECT sp.walk, sp.snarl, node, node IN (entry, exit) AS edge, count(*) AS n FROM sp JOIN l ON l.walk = sp.walk AND l.snarl = sp.snarl JOIN sn ON sn.snarl = sp.snarl JOIN w ON w.walk = sp.walk AND w.step BETWEEN s AND greatest(e, last) WHERE NOT amb GROUP BY 1, 2, 3, 4) SELECT walk, snarl, greatest(coalesce(max(n) FILTER (NOT edge), 1), coalesce(max(n) FILTER (edge) - 1, 0), 1) AS copies FROM x GROUP BY 1, 2")
def cyclic_repeat_count(spark, sf):
    return snarls.repeat_counts(A.walks(spark, sf), A.snarls(spark, "cyclic"))


def _nested(spark):
    """The ten snarls with a child each: entry 10e + 1, exit 10e + 3."""
    inner = spark.range(10).select((F.col("id") + 100).alias("snarl"), F.lit("acyclic").alias("kind"), (F.col("id") * 10 + 1).alias("entry"), (F.col("id") * 10 + 3).alias("exit"), F.col("id").alias("parent"))
    return A.snarls(spark).unionByName(inner)


#: The spans of children within the steps of their parents: the spans of walks numbered walk * 100 + parent.
CHILDREN = re.sub(r"\b(h|c1|c2|s1|s2|k|sp|w|sn)\b", r"\1_c", SPANS.removeprefix(f"{A.WALKS}, {A.SNARLS}, "))


@query(f"""WITH {SPANS}, w_c AS (SELECT sp.walk * 100 + sp.snarl AS walk, row_number() OVER (PARTITION BY sp.walk, sp.snarl ORDER BY step) - 1 AS step, node, fwd FROM sp JOIN w ON w.walk = sp.walk AND step BETWEEN s AND e WHERE NOT amb),
sn_c AS (SELECT range AS snarl, range * 10 + 1 AS entry, range * 10 + 3 AS exit FROM range(10)), {CHILDREN}, own AS (SELECT * FROM sp_c WHERE walk % 100 = snarl AND NOT amb),
x AS (SELECT w_c.walk, CASE WHEN step > e THEN 2 ELSE 0 END AS place, least(string_agg(node || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY step), string_agg(node || CASE WHEN fwd THEN '-' ELSE '+' END, ',' ORDER BY step DESC)) AS t FROM w_c LEFT JOIN own ON own.walk = w_c.walk WHERE s IS NULL OR step < s OR step > e GROUP BY 1, 2
UNION ALL SELECT walk, 1, '{{' || (snarl + 100) || '}}' FROM own)
SELECT walk // 100 AS walk, walk % 100 AS snarl, string_agg(t, '|' ORDER BY place) AS label, CAST(count(*) FILTER (place = 1) AS INTEGER) AS children FROM x GROUP BY x.walk""")
def skeleton_signature(spark, sf):
    return snarls.skeleton_signatures(A.walks(spark, sf), _nested(spark)).select("walk", "snarl", "label", F.size("children").alias("children"))


@query()
def encode_walks(spark, sf):
    return snarls.encoded(A.walks(spark, sf), _nested(spark))


@query(f"WITH {A.PANEL} SELECT site, label, n, round(frequency, 9) AS frequency, idx FROM p")
def allele_freq_pooled(spark, sf):
    return alleles.pooled(A.allele_calls(spark, sf)).withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {A.PANEL} SELECT c.site, c.label, p.idx FROM c JOIN p ON p.site = c.site AND p.label = CASE WHEN c.n >= 2 THEN c.label ELSE 'OTHER' END")
def allele_label_map(spark, sf):
    return alleles.label_map(A.allele_calls(spark, sf))


@query(f"WITH {A.PANEL} SELECT site, ref FROM r")
def reference_allele(spark, sf):
    return alleles.reference(alleles.pooled(A.allele_calls(spark, sf)))


CALLS = A.PANEL + ", k AS (SELECT p_brand AS site, p_partkey AS hap, p_type || '|' || (p_size % 20 + 1) AS label FROM part), q AS (SELECT k.site, hap, k.label, coalesce(x.idx, y.idx) AS idx FROM k LEFT JOIN p x ON x.site = k.site AND x.label = k.label LEFT JOIN p y ON y.site = k.site AND y.label = 'OTHER')"


def _calls(spark, sf):
    calls = A.table(spark, sf, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("hap"), F.concat_ws("|", "p_type", (F.col("p_size") % 20 + 1).cast("string")).alias("label"))
    panel = index.kept(alleles.pooled(A.allele_calls(spark, sf)))
    return alleles.allele_calls(calls, panel), panel


@query(f"WITH {CALLS} SELECT site, hap, label, idx FROM q")
def allele_call(spark, sf):
    return _calls(spark, sf)[0].select("site", "hap", "label", "idx")


@query(f"WITH {CALLS} SELECT q.site, hap, CASE WHEN p.idx < ref THEN p.idx ELSE p.idx - 1 END AS \"column\", CASE WHEN q.idx IS NULL THEN NULL WHEN q.idx = p.idx THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM q JOIN r ON r.site = q.site JOIN p ON p.site = q.site AND p.idx <> ref")
def dummy_coding(spark, sf):
    return alleles.dosages(*_calls(spark, sf))


BI = "b AS (SELECT o_orderkey AS hap, o_orderpriority AS site, o_orderstatus = 'F' AS f FROM orders), n AS (SELECT site, f, count(*) AS n FROM b GROUP BY 1, 2), rf AS (SELECT site, max_by(f, (n, f)) AS ref FROM n GROUP BY 1)"


@query(f"WITH {BI} SELECT b.site, hap, CASE WHEN f = ref THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM b JOIN rf ON rf.site = b.site")
def haploid_dosage(spark, sf):
    # labels sort F before not-F, and equal counts take the first place
    calls = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_orderkey").alias("hap"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("N").alias("label"))
    panel = alleles.pooled(calls)
    return alleles.dosages(alleles.allele_calls(calls, panel), panel).select("site", "hap", "value")


@query(f"WITH {A.PANEL}, f AS (SELECT p.site, p_partkey AS hap, p.idx, (p_size % 10) / 10.0 / k AS pr FROM p JOIN part ON p_brand = p.site JOIN r ON r.site = p.site) SELECT f.site, hap, CASE WHEN idx < ref THEN idx ELSE idx - 1 END AS \"column\", round(pr, 9) AS value FROM f JOIN r ON r.site = f.site WHERE idx <> ref AND k > 1")
def prob_dosage(spark, sf):
    panel = index.kept(alleles.pooled(A.allele_calls(spark, sf)))
    sizes = panel.groupBy("site").agg(F.count("*").alias("k"))
    parts = A.table(spark, sf, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("hap"), (F.col("p_size") % 10).alias("z"))
    # every allele of a part has the same share, rounded once
    shares = alleles.by_panel(parts, sizes, ["site"]).select("site", "hap", F.round(F.col("z") / 10.0 / F.col("k"), 9).alias("p"))
    return alleles.expected_dosages(alleles.by_panel(shares, panel.select("site", "idx"), ["site"]), panel)


DIP = "x AS (SELECT p_brand AS site, p_partkey // 2 AS ind, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size % 2 AS DOUBLE) END AS value FROM part)"


@query(f"WITH {DIP} SELECT site, ind, sum(value) AS value FROM x GROUP BY 1, 2")
def diploid_sum(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_brand").alias("site"), F.floor(F.col("p_partkey") / 2).alias("ind"), "p_partkey", F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 2).cast("double")).alias("value"))
    return alleles.diploid(p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 2 = 1").drop("p_partkey"), ["site", "ind"])


VALUES = "z AS (SELECT user_id AS individual, CAST(json_extract(props, '$.k') AS BIGINT) AS node, sum(least(greatest(value / 20, 0), 1)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


def _values(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("individual"), F.get_json_object("props", "$.k").cast("bigint").alias("node"), (F.col("value") / 20).alias("value"))
    return alleles.node_values(e)


@query(f"WITH {VALUES} SELECT individual, node, round(value, 6) AS value FROM z")
def node_values(spark, sf):
    return _values(spark, sf).withColumn("value", F.round("value", 6))


@query(f"WITH {VALUES} SELECT individual, bool_and(abs(value) <= 1e-12 OR abs(value - 1) <= 1e-12) AS hard FROM z GROUP BY 1")
def hard_call_flag(spark, sf):
    return alleles.hard_calls(_values(spark, sf))


def _signatures(spark):
    """Ten sites of three signatures: nodes 10s + i, 10s + i + 2 and the shared 10s + 9."""
    rows = spark.range(10).select(F.col("id").alias("site"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("idx"))
    return rows.select("site", "idx", F.explode(F.array(F.col("site") * 10 + F.col("idx"), F.col("site") * 10 + F.col("idx") + 2, F.col("site") * 10 + 9)).alias("node"))


SIGS = "g AS (SELECT s AS site, i AS idx, unnest([s * 10 + i, s * 10 + i + 2, s * 10 + 9]) AS node FROM (SELECT range AS s FROM range(10)), (SELECT range AS i FROM range(3)))"


@query(f"WITH {VALUES}, {SIGS}, m AS (SELECT individual, site, idx, round(sum(value) / 3, 9) AS mean FROM g JOIN z ON z.node = g.node GROUP BY 1, 2, 3) SELECT individual, site, max_by(idx, (mean, -idx)) AS idx FROM m GROUP BY 1, 2")
def best_signature(spark, sf):
    means = alleles.signature_scores(_values(spark, sf), _signatures(spark)).withColumn("mean", F.round("mean", 9))
    return means.groupBy("individual", "site").agg(F.max_by("idx", F.struct("mean", -F.col("idx"))).alias("idx"))


@query(f"""WITH {A.PANEL}, g AS (SELECT DISTINCT a.site, p.idx, p_size AS node FROM a JOIN p ON p.site = a.site AND p.label = a.label JOIN part ON p_partkey = hap),
k AS (SELECT site, count(DISTINCT idx) AS k FROM g GROUP BY 1), s AS (SELECT site, node FROM g JOIN k USING (site) GROUP BY site, node, k HAVING count(DISTINCT idx) = k),
m AS (SELECT g.*, s.node IS NOT NULL AS shared FROM g LEFT JOIN s ON s.site = g.site AND s.node = g.node)
SELECT site, idx, node FROM m WHERE NOT shared OR NOT EXISTS (SELECT 1 FROM m x WHERE x.site = m.site AND x.idx = m.idx AND NOT x.shared)""")
def informative_nodes(spark, sf):
    calls = A.allele_calls(spark, sf)
    panel = alleles.pooled(calls)
    own = calls.join(panel.select("site", "label", "idx"), ["site", "label"]).join(A.table(spark, sf, "part").select(F.col("p_partkey").alias("hap"), F.col("p_size").alias("node")), "hap")
    return alleles.informative(own.select("site", "idx", "node").distinct())


@query(f"WITH {VALUES}, {SIGS}, m AS (SELECT individual, site, idx, sum(value) / 2 AS mean FROM g JOIN z ON z.node = g.node WHERE g.node % 10 <> 9 GROUP BY 1, 2, 3 HAVING sum(value) > 0) SELECT individual, site, idx, round(mean / sum(mean) OVER (PARTITION BY individual, site), 6) AS p FROM m UNION ALL SELECT individual, site, max_by(idx, (mean, -idx)), 1.0 FROM (SELECT individual, site, idx, round(sum(value) / 3, 9) AS mean FROM g JOIN z ON z.node = g.node GROUP BY 1, 2, 3) a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.individual = a.individual AND m.site = a.site) GROUP BY 1, 2")
def signature_probabilities(spark, sf):
    return alleles.signature_probabilities(_values(spark, sf), _signatures(spark)).withColumn("p", F.round("p", 6))


@query(f"WITH {VALUES}, c AS (SELECT DISTINCT individual, node // 10 AS child FROM z WHERE value > 0.5), t AS (SELECT site, idx, node, NULL AS child FROM (SELECT s AS site, i AS idx, s * 10 + i AS node FROM (SELECT range AS s FROM range(10)), (SELECT range AS i FROM range(3)))), k AS (SELECT s AS site, i AS idx, (s + i) % 10 AS child FROM (SELECT range AS s FROM range(10)), (SELECT range AS i FROM range(3))), u AS (SELECT individual, site, idx, value FROM t JOIN z ON z.node = t.node UNION ALL SELECT individual, site, idx, 1.0 FROM k JOIN c ON c.child = k.child) SELECT individual, site, idx, round(sum(value) / 2, 6) AS mean FROM u GROUP BY 1, 2, 3")
def skeleton_score(spark, sf):
    z = _values(spark, sf)
    base = spark.range(10).select(F.col("id").alias("site"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("idx"))
    null = F.lit(None).cast("bigint")
    parts = base.select("site", "idx", (F.col("site") * 10 + F.col("idx")).alias("node"), null.alias("child")).unionByName(base.select("site", "idx", null.alias("node"), ((F.col("site") + F.col("idx")) % 10).alias("child")))
    children = z.where("value > 0.5").select("individual", F.floor(F.col("node") / 10).alias("child")).distinct()
    return snarls.skeleton_scores(z, parts, children).withColumn("mean", F.round("mean", 6))


@query(f"WITH {VALUES} SELECT individual, node // 10 AS snarl, round(max(value), 6) AS support FROM z WHERE node % 10 BETWEEN 1 AND 4 GROUP BY 1, 2")
def cyclic_support(spark, sf):
    cycles = spark.range(100).where("id % 10 between 1 and 4").select(F.floor(F.col("id") / 10).alias("snarl"), F.col("id").alias("node"))
    return snarls.cyclic_support(_values(spark, sf), cycles).withColumn("support", F.round("support", 6))


@query(f"WITH {VALUES}, {A.SNARLS} SELECT a.individual, snarl FROM sn JOIN z a ON a.node = entry AND a.value > 0 JOIN z b ON b.node = exit AND b.value > 0 AND b.individual = a.individual")
def traversed_snarls(spark, sf):
    return snarls.traversed(_values(spark, sf), A.snarls(spark))


#: Node values encoded against a panel of walks: labels lb, alleles p, sites st, parts g (gi without shared nodes).
ENCODED = f"""{A.BUBBLES}, gr AS (SELECT a.walk, snarl, a.step AS s, c.step AS e FROM sn JOIN w a ON a.node = entry JOIN w c ON c.node = exit AND c.walk = a.walk),
lb AS (SELECT walk, snarl, least(f, r) AS label FROM (SELECT gr.walk, snarl, string_agg(node || CASE WHEN fwd THEN '+' ELSE '-' END, ',' ORDER BY step) AS f, string_agg(node || CASE WHEN fwd THEN '-' ELSE '+' END, ',' ORDER BY step DESC) AS r FROM gr JOIN w ON w.walk = gr.walk AND step BETWEEN s AND e GROUP BY 1, 2)
UNION ALL SELECT walk, snarl, node || '+' FROM w JOIN sn ON node = entry OR node = exit WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.walk = w.walk AND gr.snarl = sn.snarl)),
cn AS (SELECT snarl, label, count(*) AS n FROM lb GROUP BY 1, 2), p0 AS (SELECT snarl, CASE WHEN n > 1 THEN label ELSE 'OTHER' END AS label, n = 1 AS rest, sum(n) AS n FROM cn GROUP BY 1, 2, 3),
p AS (SELECT snarl, label, n, row_number() OVER (PARTITION BY snarl ORDER BY rest, n DESC, label) - 1 AS idx FROM p0),
st AS (SELECT snarl, ref, sum(k - 1) OVER (ORDER BY snarl) - k + 1 AS f0 FROM (SELECT snarl, max_by(idx, (n, -idx)) AS ref, count(*) AS k FROM p GROUP BY 1) WHERE k > 1),
g AS (SELECT snarl, idx, CAST(regexp_extract(t, '[0-9]+') AS BIGINT) AS node FROM (SELECT snarl, idx, unnest(string_split(label, ',')) AS t FROM p WHERE label <> 'OTHER')),
sh AS (SELECT snarl, node FROM g JOIN (SELECT snarl, count(DISTINCT idx) AS k FROM g GROUP BY 1) USING (snarl) GROUP BY snarl, node, k HAVING count(DISTINCT idx) = k),
gm AS (SELECT g.*, sh.node IS NOT NULL AS common FROM g LEFT JOIN sh ON sh.snarl = g.snarl AND sh.node = g.node), gi AS (SELECT snarl, idx, node FROM (SELECT *, bool_and(common) OVER (PARTITION BY snarl, idx) AS alone FROM gm) WHERE alone OR NOT common),
hd AS (SELECT individual, bool_and(abs(value) <= 1e-12 OR abs(value - 1) <= 1e-12) AS hard FROM z GROUP BY 1),
vis AS (SELECT individual, hard, snarl, ref, f0 FROM st JOIN sn USING (snarl) JOIN z x ON x.node = entry AND x.value > 0 JOIN z y USING (individual) JOIN hd USING (individual) WHERE y.node = exit AND y.value > 0),
q AS (SELECT snarl, coalesce((SELECT min(idx) FROM g WHERE g.snarl = o.snarl), o.idx) AS pick FROM (SELECT snarl, max(idx) AS idx FROM p GROUP BY 1) o),
sc AS (SELECT individual, snarl, idx, round(sum(value) / size, 9) AS mean FROM g JOIN z USING (node) JOIN (SELECT snarl, idx, count(*) AS size FROM g GROUP BY 1, 2) USING (snarl, idx) GROUP BY 1, 2, 3, size HAVING sum(value) > 0),
si AS (SELECT individual, snarl, idx, sum(value) / size AS mean FROM gi JOIN z USING (node) JOIN (SELECT snarl, idx, count(*) AS size FROM gi GROUP BY 1, 2) USING (snarl, idx) GROUP BY 1, 2, 3, size HAVING sum(value) > 0),
bs AS (SELECT individual, snarl, max_by(idx, (mean, -idx)) AS best FROM sc GROUP BY 1, 2), tt AS (SELECT individual, snarl, sum(mean) AS total FROM si GROUP BY 1, 2),
en AS (SELECT vis.individual, CAST(f0 + CASE WHEN p.idx < ref THEN p.idx ELSE p.idx - 1 END AS BIGINT) AS feature,
CASE WHEN hard THEN CASE WHEN p.idx = coalesce(best, pick) THEN 1.0 ELSE 0.0 END WHEN total IS NULL THEN CASE WHEN p.idx = pick THEN 1.0 ELSE 0.0 END ELSE coalesce(mean, 0.0) / total END::DOUBLE AS value
FROM vis JOIN p ON p.snarl = vis.snarl AND p.idx <> ref JOIN q ON q.snarl = vis.snarl LEFT JOIN bs ON bs.individual = vis.individual AND bs.snarl = vis.snarl LEFT JOIN tt ON tt.individual = vis.individual AND tt.snarl = vis.snarl LEFT JOIN si ON si.individual = vis.individual AND si.snarl = vis.snarl AND si.idx = p.idx)"""


def _encoded_values(spark, sf):
    walks, sites, readings = A.bubbles(spark, sf)
    return snarls.encoded_values(alleles.node_values(readings), walks, sites)


@query(f"WITH {ENCODED} SELECT individual, feature, round(value + 1e-9, 6) AS value FROM en")
def encode_node_values(spark, sf):
    # shares are often sums of halves: off the ties of rounding
    return _encoded_values(spark, sf).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(f"WITH {ENCODED} SELECT individual // 8 AS pair, feature, round(sum(value), 5) AS value FROM en WHERE individual % 4 = 0 GROUP BY 1, 2")
def diploid_node_values(spark, sf):
    sure = _encoded_values(spark, sf).where("individual % 4 = 0").select(F.floor(F.col("individual") / 8).alias("pair"), (F.col("individual") % 8 == 0).alias("left"), "feature", "value")
    left, right = sure.where("left").drop("left"), sure.where("not left").drop("left")
    return alleles.diploid(left, right, ["pair", "feature"]).withColumn("value", F.round("value", 5))


@query(f"WITH {A.PANEL}, s AS (SELECT site, min(frequency) AS lo, sum(frequency) AS t, max(idx) AS l, count(*) AS k FROM p GROUP BY 1) SELECT unnest(['negative', 'sum', 'gap']) AS rule, unnest([sum(CASE WHEN lo < 0 THEN 1 ELSE 0 END), sum(CASE WHEN abs(t - 1) > 1e-9 THEN 1 ELSE 0 END), sum(CASE WHEN l + 1 <> k THEN 1 ELSE 0 END)])::BIGINT AS broken FROM s")
def panel_expectations(spark, sf):
    return alleles.expectations(alleles.pooled(A.allele_calls(spark, sf)))


# Topologies: regions are parents, nations their children


def _geography(spark, sf):
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    null = F.lit(None).cast("bigint")
    tops = r.select(F.col("r_regionkey").cast("bigint").alias("snarl"), F.lit("acyclic").alias("kind"), (F.col("r_regionkey") * 1000).cast("bigint").alias("entry"), (F.col("r_regionkey") * 1000 + 999).cast("bigint").alias("exit"), null.alias("parent"), (F.col("r_regionkey") * 4 + 2).cast("bigint").alias("alleles"), F.lit(2).cast("bigint").alias("skeletons"))
    leaves = n.select((F.col("n_nationkey") + 100).cast("bigint").alias("snarl"), F.when(F.col("n_nationkey") % 6 == 5, "cyclic").otherwise("acyclic").alias("kind"), (F.col("n_regionkey") * 1000 + F.col("n_nationkey") * 10 + 1).cast("bigint").alias("entry"), (F.col("n_regionkey") * 1000 + F.col("n_nationkey") * 10 + 5).cast("bigint").alias("exit"), F.col("n_regionkey").cast("bigint").alias("parent"), (F.col("n_nationkey") % 4 + 1).cast("bigint").alias("alleles"), null.alias("skeletons"))
    return tops.unionByName(leaves)


GEO = """t AS (SELECT r_regionkey::BIGINT AS snarl, 'acyclic' AS kind, r_regionkey * 1000 AS entry, r_regionkey * 1000 + 999 AS exit, NULL::BIGINT AS parent, r_regionkey * 4 + 2 AS k, 2 AS ks FROM region UNION ALL
SELECT n_nationkey + 100, CASE WHEN n_nationkey % 6 = 5 THEN 'cyclic' ELSE 'acyclic' END, n_regionkey * 1000 + n_nationkey * 10 + 1, n_regionkey * 1000 + n_nationkey * 10 + 5, n_regionkey, n_nationkey % 4 + 1, NULL FROM nation),
lc AS (SELECT snarl, parent, CASE WHEN kind = 'cyclic' THEN 1 ELSE k - 1 END AS c FROM t WHERE parent IS NOT NULL), pc AS (SELECT t.snarl, t.k - 1 AS f, t.ks - 1 + sum(c) AS d FROM t JOIN lc ON lc.parent = t.snarl GROUP BY 1, 2, t.ks),
st AS (SELECT snarl, NULL::BIGINT AS parent, snarl AS o1, -1 AS o2, CASE WHEN f < d THEN 'flat' ELSE 'skeleton' END AS site_kind, CASE WHEN f < d THEN f ELSE 1 END AS c, 0 AS depth FROM pc UNION ALL
SELECT lc.snarl, lc.parent, lc.parent, lc.snarl, CASE WHEN kind = 'cyclic' THEN 'cyclic' ELSE 'leaf' END, c, 1 FROM lc JOIN t ON t.snarl = lc.snarl JOIN pc ON pc.snarl = lc.parent WHERE f >= d),
ft AS (SELECT *, CAST(sum(c) OVER (ORDER BY o1, o2) AS BIGINT) AS e FROM st WHERE c > 0)"""


@query(f"WITH {GEO} SELECT snarl, site_kind, CAST(c AS BIGINT) AS columns, depth, parent, CAST(e - c AS BIGINT) AS feature_start, e AS feature_end FROM ft")
def feature_offsets(spark, sf):
    return snarls.feature_sites(_geography(spark, sf)).drop("place")


@query(f"WITH {GEO} SELECT t.snarl, CASE WHEN t.parent IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN t.parent IS NULL THEN CAST(t.snarl AS VARCHAR) ELSE t.parent || '/' || t.snarl END AS path FROM t")
def topology_load(spark, sf):
    return snarls.tree(_geography(spark, sf)).select("snarl", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(f"WITH {GEO} SELECT CAST(ft.e - ft.c AS BIGINT) AS feature_id, ft.snarl, CAST(t.entry AS BIGINT) AS entry, CAST(t.exit AS BIGINT) AS exit, CAST(CASE WHEN ft.site_kind = 'cyclic' THEN 0 ELSE t.k END AS BIGINT) AS k, ft.site_kind = 'cyclic' AS cyclic, CAST(p.e - p.c AS BIGINT) AS parent_feature FROM ft JOIN t ON t.snarl = ft.snarl LEFT JOIN ft p ON p.snarl = ft.parent")
def catalog_records(spark, sf):
    geo = _geography(spark, sf)
    return snarls.catalog(snarls.feature_sites(geo), geo, geo.select("snarl", F.col("alleles").alias("k")))


# Matrices and texts


CELLS = "c AS (SELECT vec_id AS row, unnest(range(len(embedding)))::INTEGER AS col, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {CELLS}, f AS (SELECT col, avg(value) AS m, stddev_pop(value) AS s FROM c WHERE value <> 0 GROUP BY 1) SELECT row, c.col, round(value, 6) AS value, round(CASE WHEN s > 0 THEN least(greatest((value - (m - 2 * s)) / (4 * s), 0), 1) ELSE 0.5 END, 6) AS z FROM c JOIN f ON f.col = c.col")
def znorm_nonzero(spark, sf):
    return matrices.standardized(matrices.long_form(A.table(spark, sf, "embeddings"), "vec_id", "embedding")).select("row", "col", F.round("value", 6).alias("value"), F.round("z", 6).alias("z"))


@query(f"WITH {CELLS}, f AS (SELECT min(value) AS lo, max(value) AS hi FROM c) SELECT row, col, round(CASE WHEN value = 0 THEN 0 ELSE least(greatest((value - lo) / (hi - lo), 0), 1) END, 6) AS intensity FROM c, f")
def heatmap_intensity(spark, sf):
    return matrices.min_max(matrices.long_form(A.table(spark, sf, "embeddings"), "vec_id", "embedding")).select("row", "col", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {CELLS}, v AS (SELECT col AS k, sum(value) AS x FROM c GROUP BY 1), f AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT row, round(sum(abs(value) * (x - lo) / (hi - lo)), 5) AS importance FROM c JOIN v ON v.k = c.col, f GROUP BY 1")
def weighted_importance(spark, sf):
    cells = matrices.long_form(A.table(spark, sf, "embeddings"), "vec_id", "embedding")
    values = cells.groupBy(F.col("col").alias("k")).agg(F.sum("value").alias("eigenvalue"))
    return matrices.weighted_importance(cells.select("row", F.col("col").alias("k"), F.col("value").alias("v")), values).withColumn("importance", F.round("importance", 5))


@query(f"WITH {CELLS}, v AS (SELECT col AS k, sum(value) AS x FROM c GROUP BY 1), f AS (SELECT min(x) AS lo, max(x) AS hi FROM v), i AS (SELECT row, round(sum(abs(value) * (x - lo) / (hi - lo)), 5) AS importance FROM c JOIN v ON v.k = c.col, f GROUP BY 1) SELECT row, row_number() OVER (ORDER BY importance DESC, row) - 1 AS place FROM i")
def importance_rank(spark, sf):
    return index.with_rank(weighted_importance(spark, sf), F.desc("importance"), "row", name="place").select("row", "place")


@query("SELECT count(DISTINCT c_custkey % 50) AS samples, count(DISTINCT (c_custkey % 50, c_custkey % 3)) AS haplotypes, count(DISTINCT c_nationkey) AS contigs FROM customer")
def name_counts(spark, sf):
    from ..sources import gfa
    from .pipelines import name_counts as counts

    key = F.col("c_custkey")
    name = F.concat(F.lit("s"), (key % 50).cast("string"), F.lit("#"), (key % 3).cast("string"), F.lit("#chr"), F.col("c_nationkey").cast("string"))
    return counts(gfa.path_names(A.table(spark, sf, "customer").select(name.alias("walk"))))


@query("""WITH t AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+') AS a FROM documents), x AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM t),
n AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM x WHERE word <> ''), e AS (SELECT DISTINCT least(word, nxt) AS a, greatest(word, nxt) AS b FROM n WHERE nxt IS NOT NULL AND word <> nxt)
SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1""")
def word_graph_degree(spark, sf):
    words = A.table(spark, sf, "documents").select(S.plain_words(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("src"), F.get(F.col("w"), i + 1).alias("dst")))).alias("p")).select("p.src", "p.dst")
    return graph.degrees(graph.distinct_edges(pairs).where("src <> dst"))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT range AS src, (range + k) % n AS dst FROM range(0, (SELECT n FROM n)), n, (SELECT unnest([1, 2, 3]) AS k)")
def circulant_graph(spark, sf):
    return generators.circulant(spark, A.table(spark, sf, "customer").count(), (1, 2, 3))


@query("WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT a.range AS src, a.range // 10 * 10 + b.range AS dst FROM range(0, (SELECT n * 10 FROM n)) a, range(10) b WHERE a.range % 10 < b.range) SELECT src, dst FROM c UNION ALL SELECT range * 10 + 9, range * 10 + 10 FROM range(0, (SELECT n - 1 FROM n))")
def path_communities(spark, sf):
    return generators.path_of_cliques(spark, A.table(spark, sf, "supplier").count(), 10)


COLOURS = "q AS (SELECT vec_id AS id, (vec_id * 37) % 360 AS h FROM embeddings), c AS (SELECT id, h, h / 60.0 AS k, 0.6 AS chroma FROM q), x AS (SELECT *, chroma * (1 - abs(k - 2 * floor(k / 2) - 1)) AS x FROM c)"


@query(f"WITH {COLOURS} SELECT id, CAST(round(255 * (0.2 + CASE WHEN k < 1 THEN chroma WHEN k < 2 THEN x WHEN k < 4 THEN 0 WHEN k < 5 THEN x ELSE chroma END)) AS BIGINT) AS r, CAST(round(255 * (0.2 + CASE WHEN k < 1 THEN x WHEN k < 3 THEN chroma WHEN k < 4 THEN x ELSE 0 END)) AS BIGINT) AS g, CAST(round(255 * (0.2 + CASE WHEN k < 2 THEN 0 WHEN k < 3 THEN x WHEN k < 5 THEN chroma ELSE x END)) AS BIGINT) AS b FROM x")
def cluster_colours(spark, sf):
    ids = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") * 37) % 360).alias("h"))
    return ids.select("id", *[c.alias(n) for n, c in zip("rgb", S.hsl_to_rgb(F.col("h"), F.lit(0.6), F.lit(0.5)))])


@query('WITH l AS (SELECT 100 * count(*) + 500 AS n FROM orders) SELECT range AS start, least(range + 2000, n) AS "end", (range + least(range + 2000, n)) / 2.0 AS midpoint FROM range(0, (SELECT n FROM l), 2000), l')
def window_midpoints(spark, sf):
    return windows.coordinate_windows(spark, 0, 100 * A.table(spark, sf, "orders").count() + 500, 2000).select("start", "end", S.midpoint(F.col("start"), F.col("end")).alias("midpoint"))


@query("""WITH v AS (SELECT p_partkey, CAST(p_size - 1 AS DOUBLE) AS x FROM part), f AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM v WHERE x <> 0),
d AS (SELECT p_partkey, x, least(greatest((x - m) / s, -2), 2) AS d FROM v, f)
SELECT p_partkey, round(CASE WHEN x <> 0 AND d >= 0 THEN d / 2 ELSE 0 END, 6) + 0.0 AS r, 0.0::DOUBLE AS g, round(CASE WHEN x <> 0 AND d < 0 THEN -d / 2 ELSE 0 END, 6) + 0.0 AS b, 1.0::DOUBLE AS alpha FROM d""")
def deviation_colours(spark, sf):
    v = A.table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 1).cast("double").alias("x"))
    facts = v.where("x <> 0").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    coloured = S.deviation_colour(F.col("x"), (F.col("x") - F.col("m")) / F.col("s"))
    return v.join(F.broadcast(facts), F.lit(True)).select("p_partkey", *(F.round(c, 6).alias(n) for n, c in zip(("r", "g", "b", "alpha"), coloured)))


from . import stored_queries  # noqa: E402,F401  registers its queries
