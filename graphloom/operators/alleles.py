"""Alleles of sites over haplotypes: calls(site, hap, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AMBIGUOUS, MISSING, OTHER
from .index import kept


def pooled(calls: DataFrame, keep_reserved: bool = True) -> DataFrame:
    """(site, label, n, frequency, idx): labels by falling count, then by bytes; singletons pooled as OTHER, last.

    Reserved labels are kept even where they occur once, if ``keep_reserved``.
    """
    counts = calls.groupBy("site", "label").agg(F.count("*").alias("n"))
    kept = F.col("n") >= 2
    if keep_reserved:
        kept = kept | F.col("label").isin(AMBIGUOUS, MISSING)
    groups = counts.groupBy("site", F.when(kept, F.col("label")).otherwise(OTHER).alias("label"), (~kept).alias("rest")).agg(F.sum("n").alias("n"))
    site = Window.partitionBy("site")
    order = site.orderBy("rest", F.desc("n"), "label")
    return groups.select("site", "label", "n", (F.col("n") / F.sum("n").over(site)).alias("frequency"), (F.row_number().over(order) - 1).cast("bigint").alias("idx"))


def label_map(calls: DataFrame) -> DataFrame:
    """(site, label, idx): the place of every label seen, singletons at OTHER."""
    counts = calls.groupBy("site", "label").agg(F.count("*").alias("n"))
    rest = (F.col("n") < 2) & ~F.col("label").isin(AMBIGUOUS, MISSING)
    # a label called OTHER that is not pooled stays itself
    place = pooled(calls).select("site", F.col("label").alias("at"), "idx")
    return counts.select("site", "label", F.when(rest, OTHER).otherwise(F.col("label")).alias("at")).join(place, ["site", "at"]).select("site", "label", "idx")


def allele_calls(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """calls with idx from panel(site, label, idx): a label not in the panel is OTHER, null where that is not in it."""
    direct = panel.select("site", "label", "idx")
    other = panel.where(F.col("label") == OTHER).select("site", F.col("idx").alias("rest"))
    return calls.join(direct, ["site", "label"], "left").join(other, "site", "left").withColumn("idx", F.coalesce("idx", "rest")).drop("rest")


def reference(panel: DataFrame) -> DataFrame:
    """(site, ref): the first place of the largest frequency."""
    return panel.groupBy("site").agg(F.max_by("idx", F.struct("frequency", -F.col("idx"))).alias("ref"))


def dosage_columns(panel: DataFrame) -> DataFrame:
    """(site, idx, k, ref, column): one feature for two alleles, one for each but the reference for more, none for one."""
    facts = panel.groupBy("site").agg(F.count("*").alias("k")).join(reference(panel), "site")
    order = Window.partitionBy("site").orderBy("idx")
    rows = panel.select("site", "idx").join(facts, "site").where((F.col("k") > 1) & (F.col("idx") != F.col("ref")))
    return rows.withColumn("column", (F.row_number().over(order) - 1).cast("bigint"))


#: Rows of a panel up to which they are sent to all tasks, and rows a site from which the other side is dealt anew.
SENT, MANY = 1 << 20, 8


def by_panel(rows: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows joined with facts, some rows a site of a panel.

    Few facts are sent to all tasks, so that what comes out is never exchanged. Sites are few and take all rows of a
    table, so where each row meets many facts, rows are dealt anew first: a small file would be read, and come apart, in
    a task or two.
    """
    facts = kept(facts)
    n, keys = facts.agg(F.count("*"), F.countDistinct(*on)).first()
    if n > SENT:
        return rows.join(facts, list(on))
    if n >= MANY * keys:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.join(F.broadcast(facts), list(on))


def dosages(called: DataFrame, panel: DataFrame) -> DataFrame:
    """(site, hap, column, value): 1 where a haplotype carries the column's allele, else 0; null where it has no call."""
    columns = dosage_columns(panel).select("site", F.col("idx").alias("allele"), "column")
    return by_panel(called.select("site", "hap", "idx"), columns, ["site"]).select("site", "hap", "column", (F.col("idx") == F.col("allele")).cast("double").alias("value"))


def expected_dosages(probabilities: DataFrame, panel: DataFrame) -> DataFrame:
    """As dosages, from probabilities(site, hap, idx, p)."""
    columns = dosage_columns(panel).select("site", "idx", "column")
    return by_panel(probabilities, columns, ["site", "idx"]).select("site", "hap", "column", F.col("p").alias("value"))


def diploid(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of two encodings; a null counts as nothing, and two nulls as null."""
    return left.unionByName(right).groupBy(*by).agg(F.sum("value").alias("value"))


def diploid_sites(left: DataFrame, right: DataFrame, site: Sequence[str], column: str = "column") -> DataFrame:
    """As diploid, of site vectors with one row for each column; refuses sites whose two vectors differ in length."""
    sizes = [side.groupBy(*site).agg(F.count("*").alias(n)) for side, n in ((left, "a"), (right, "b"))]
    odd = sizes[0].join(sizes[1], list(site)).where("a <> b").first()
    if odd is not None:
        raise ValueError(f"the vectors of {[odd[c] for c in site]} have {odd['a']} and {odd['b']} columns")
    return diploid(left, right, [*site, column])


def expectations(panel: DataFrame) -> DataFrame:
    """(rule, broken): sites whose frequencies are negative, do not sum to 1, or whose places have gaps."""
    site = panel.groupBy("site").agg(F.min("frequency").alias("low"), F.sum("frequency").alias("total"), F.max("idx").alias("last"), F.count("*").alias("k"))

    def count(rule: str, broken: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.sum(F.when(broken, 1).otherwise(0)).alias("broken"))

    rules = site.agg(F.array(count("negative", F.col("low") < 0), count("sum", F.abs(F.col("total") - 1) > 1e-9), count("gap", F.col("last") + 1 != F.col("k"))).alias("r"))
    return rules.select(F.explode("r").alias("r")).select("r.*")


def node_values(readings: DataFrame) -> DataFrame:
    """(individual, node, value): readings clamped to [0, 1] and summed; what is not finite is left out."""
    from ..functions.scalars import unit

    return readings.withColumn("value", unit(F.col("value"))).where("value is not null").groupBy("individual", "node").agg(F.sum("value").alias("value"))


def hard_calls(values: DataFrame) -> DataFrame:
    """(individual, hard): whether all values are 0 or 1."""
    near = (F.abs("value") <= 1e-12) | (F.abs(F.col("value") - 1) <= 1e-12)
    return values.groupBy("individual").agg(F.bool_and(near).alias("hard"))


def signature_scores(values: DataFrame, signatures: DataFrame) -> DataFrame:
    """(individual, site, idx, mean): mean value of each signature's nodes; a node without a value counts 0.

    signatures(site, idx, node) has one row for each node of a signature.
    """
    sizes = signatures.groupBy("site", "idx").agg(F.count("*").alias("size"))
    sums = signatures.join(values, "node").groupBy("individual", "site", "idx").agg(F.sum("value").alias("sum"))
    return sums.join(sizes, ["site", "idx"]).select("individual", "site", "idx", (F.col("sum") / F.col("size")).alias("mean"))


def best_signatures(values: DataFrame, signatures: DataFrame) -> DataFrame:
    """(individual, site, idx): the signature of the largest mean, the first of several."""
    return signature_scores(values, signatures).groupBy("individual", "site").agg(F.max_by("idx", F.struct("mean", -F.col("idx"))).alias("idx"))


def informative(signatures: DataFrame) -> DataFrame:
    """signatures without the nodes that all of a site's share; a signature of shared nodes alone keeps them."""
    k = signatures.groupBy("site").agg(F.countDistinct("idx").alias("k"))
    shared = signatures.groupBy("site", "node").agg(F.countDistinct("idx").alias("n")).join(k, "site").where("n = k").select("site", "node", F.lit(True).alias("shared"))
    marked = signatures.join(shared, ["site", "node"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    alone = F.min(F.col("shared").cast("int")).over(Window.partitionBy("site", "idx")) == 1
    return marked.withColumn("alone", alone).where("not shared or alone").select("site", "idx", "node")


def signature_probabilities(values: DataFrame, signatures: DataFrame) -> DataFrame:
    """(individual, site, idx, p): means over informative nodes, normalized in a site.

    Where all of a site's means are 0, the best signature by all its nodes has p = 1. Individuals without a reading at
    any node of a site have no row there.
    """
    site = ["individual", "site"]
    scored = signature_scores(values, informative(signatures)).where("mean > 0")
    shares = scored.select(*site, "idx", (F.col("mean") / F.sum("mean").over(Window.partitionBy(*site))).alias("p"))
    hard = best_signatures(values, signatures).join(scored.select(*site).distinct(), site, "left_anti")
    return shares.unionByName(hard.select(*site, "idx", F.lit(1.0).alias("p")))
