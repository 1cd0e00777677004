"""Nested variant sites (snarls) over walks: spans, signatures, panels, feature choice and encoding.

walks(walk, step, node, fwd) are long; snarls(snarl, kind, entry, exit, parent) are metadata, one row for a site, with
kind ``acyclic`` or ``cyclic``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AMBIGUOUS, MISSING, OTHER, signature, signature_nodes
from . import blocks
from .alleles import pooled
from .index import stored


class TopologyError(ValueError):
    """A topology with an id that occurs twice, a missing parent or a cycle."""


def boundary_hits(walks: DataFrame, snarls: DataFrame, by: Sequence[str] = ("walk",)) -> DataFrame:
    """(by, snarl, step, at_entry, at_exit): steps on a boundary node, by one equi-join on the node."""
    ends = snarls.select("snarl", *[c for c in by if c != "walk"], F.explode(F.array(F.struct(F.col("entry").alias("node"), F.lit(True).alias("in")), F.struct(F.col("exit").alias("node"), F.lit(False).alias("in")))).alias("b"))
    ends = ends.select("snarl", *[c for c in by if c != "walk"], "b.node", "b.in")
    on = ["node", *[c for c in by if c != "walk"]]
    met = walks.join(ends, on)
    return met.groupBy(*by, "snarl", "step").agg(F.bool_or("in").alias("at_entry"), F.bool_or(~F.col("in")).alias("at_exit"))


def spans(hits: DataFrame, by: Sequence[str] = ("walk",)) -> DataFrame:
    """(by, snarl, start, end, ambiguous) of every snarl that a walk touches.

    Candidates go from an entry to the first exit not before it, and from an exit back to the last entry not after it.
    The first candidate is the span; a candidate that lies apart from it makes the span ambiguous. Without candidates
    the same is tried from exit to entry, and then a lone boundary is a span of one step.
    """
    key = Window.partitionBy(*by, "snarl").orderBy("step")
    behind, ahead = key.rowsBetween(Window.unboundedPreceding, 0), key.rowsBetween(0, Window.unboundedFollowing)

    def at(flag: str):
        return F.when(F.col(flag), F.col("step"))

    near = hits.select(
        *by, "snarl", "step", "at_entry", "at_exit",
        F.min(at("at_exit")).over(ahead).alias("next_exit"), F.max(at("at_entry")).over(behind).alias("last_entry"),
        F.min(at("at_entry")).over(ahead).alias("next_entry"), F.max(at("at_exit")).over(behind).alias("last_exit"),
    )

    def pair(cond, a, b):
        return F.when(cond & a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))

    step = F.col("step")
    there = (pair(F.col("at_entry"), step, F.col("next_exit")), pair(F.col("at_exit"), F.col("last_entry"), step))
    back = (pair(F.col("at_exit"), step, F.col("next_entry")), pair(F.col("at_entry"), F.col("last_exit"), step))
    found = near.groupBy(*by, "snarl").agg(
        F.min(F.least(*there)).alias("there"), F.max(F.greatest(*[c["start"] for c in there])).alias("there_last"),
        F.min(F.least(*back)).alias("back"), F.max(F.greatest(*[c["start"] for c in back])).alias("back_last"),
        F.min("step").alias("alone"),
    )
    span = F.coalesce("there", "back", F.struct(F.col("alone").alias("start"), F.col("alone").alias("end")))
    apart = F.when(F.col("there").isNotNull(), F.col("there_last") > F.col("there.end")).when(F.col("back").isNotNull(), F.col("back_last") > F.col("back.end")).otherwise(False)
    return found.select(*by, "snarl", span.alias("s"), apart.alias("ambiguous")).select(*by, "snarl", "s.start", "s.end", "ambiguous")


#: Steps in one bucket of the range join of walks and spans.
BUCKET = 1024


def within_spans(walks: DataFrame, found: DataFrame) -> DataFrame:
    """The steps of walks that lie in spans found(walk, start, end, ...): an equi-join on (walk, bucket of steps).

    A span is repeated for each bucket it meets, and a step lies in one bucket, so a walk of many steps and spans is as
    many small joins and not one of all with all.
    """
    (bucket,) = blocks.fresh(walks.select(*walks.columns, *(F.lit(0).alias(c) for c in found.columns if c not in walks.columns)), "bucket")
    cut = found.withColumn(bucket, F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    placed = walks.withColumn(bucket, F.floor(F.col("step") / BUCKET))
    return placed.join(cut, ["walk", bucket]).where(F.col("step").between(F.col("start"), F.col("end"))).drop(bucket)


def span_steps(walks: DataFrame, found: DataFrame) -> DataFrame:
    """(walk, snarl, steps): the steps of each unambiguous span, in order."""
    inside = within_spans(walks, found.where("not ambiguous").select("walk", "snarl", "start", "end"))
    rows = F.sort_array(F.collect_list(F.struct("step", "node", "fwd")))
    return inside.groupBy("walk", "snarl").agg(rows.alias("steps"))


def flat_signatures(walks: DataFrame, snarls: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(walk, snarl, label): the signature of each span, or the reserved label of an ambiguous one.

    found is spans() of all walks and snarls where it is there already, here and below.
    """
    found = spans(boundary_hits(walks, snarls)) if found is None else found
    clear = span_steps(walks, found).select("walk", "snarl", signature(F.col("steps")).alias("label"))
    return clear.unionByName(found.where("ambiguous").select("walk", "snarl", F.lit(AMBIGUOUS).alias("label")))


def skeleton_signatures(walks: DataFrame, snarls: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(walk, snarl, label, children): spans of snarls with children, each child's span as ``{child}``."""
    inner = snarls.where("parent is not null").select("snarl", "entry", "exit", F.col("parent").alias("of"))
    parents = inner.select(F.col("of").alias("snarl")).distinct()
    found = spans(boundary_hits(walks, snarls)) if found is None else found
    steps = span_steps(walks, found.join(parents, "snarl", "left_semi"))
    # a child is looked for within its parent's steps, numbered anew
    own = steps.select("walk", F.col("snarl").alias("of"), F.posexplode("steps").alias("step", "s")).select("walk", "of", F.col("step").cast("bigint").alias("step"), "s.node")
    child = spans(boundary_hits(own, inner, ("walk", "of")), ("walk", "of")).where("not ambiguous")
    lists = child.groupBy("walk", F.col("of").alias("snarl")).agg(F.sort_array(F.collect_list(F.struct("start", F.col("snarl").alias("child"), "end"))).alias("kids"))
    joined = steps.join(lists, ["walk", "snarl"], "left")
    none = F.array().cast("array<string>")

    def piece(a, b):
        return F.when(b > a, F.array(signature(F.slice("steps", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))))).otherwise(none)

    def add(acc, k):
        parts = F.concat(acc["parts"], piece(acc["cursor"], k["start"]), F.array(F.concat(F.lit("{"), k["child"].cast("string"), F.lit("}"))))
        return F.struct((k["end"] + 1).cast("bigint").alias("cursor"), parts.alias("parts"))

    zero = F.struct(F.lit(0).cast("bigint").alias("cursor"), none.alias("parts"))
    kids = F.coalesce("kids", F.array().cast(joined.schema["kids"].dataType))
    stitched = joined.select("walk", "snarl", "steps", kids.alias("kids")).withColumn("done", F.aggregate("kids", zero, add))
    label = F.array_join(F.concat(F.col("done.parts"), piece(F.col("done.cursor"), F.size("steps").cast("bigint"))), "|")
    return stitched.select("walk", "snarl", label.alias("label"), F.transform("kids", lambda k: k["child"]).alias("children"))


def repeat_counts(walks: DataFrame, snarls: DataFrame) -> DataFrame:
    """(walk, snarl, copies) of cyclic snarls.

    The span is drawn out to the last boundary hit behind it; copies are the larger of the most repeated inner node and
    the revisits of a boundary, 1 at least.
    """
    cyclic = snarls.where("kind = 'cyclic'")
    hits = boundary_hits(walks, cyclic)
    found = spans(hits).where("not ambiguous")
    last = hits.groupBy("walk", "snarl").agg(F.max("step").alias("last"))
    drawn = found.join(last, ["walk", "snarl"]).select("walk", "snarl", "start", F.greatest("end", "last").alias("end"))
    ends = cyclic.select("snarl", "entry", "exit")
    inside = within_spans(walks, drawn).join(ends, "snarl")
    per_node = inside.groupBy("walk", "snarl", "node", "entry", "exit").agg(F.count("*").alias("n"))
    entry, exit_ = F.col("node") == F.col("entry"), F.col("node") == F.col("exit")
    facts = per_node.groupBy("walk", "snarl").agg(F.max(F.when(~entry & ~exit_, F.col("n"))).alias("inner"), F.max(F.when(entry | exit_, F.col("n"))).alias("outer"))
    return facts.select("walk", "snarl", F.greatest(F.coalesce("inner", F.lit(1)), F.coalesce(F.col("outer") - 1, F.lit(0)), F.lit(1)).alias("copies"))


def panel(walks: DataFrame, snarls: DataFrame) -> dict[str, DataFrame]:
    """Flat and skeleton alleles with frequencies, the skeleton alleles a child occurs in, and inner nodes of cycles."""
    return panel_of(flat_signatures(walks, snarls), skeleton_signatures(walks, snarls), walks, snarls)


def panel_of(flat: DataFrame, skeleton: DataFrame, walks: DataFrame, snarls: DataFrame, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """As panel, from signatures computed before."""
    site = F.col("snarl").alias("site")
    flat_panel = pooled(flat.select(site, F.col("walk").alias("hap"), "label"))
    skeleton_panel = pooled(skeleton.select(site, F.col("walk").alias("hap"), "label"))
    from .alleles import label_map

    places = label_map(skeleton.select(site, F.col("walk").alias("hap"), "label"))
    seen = skeleton.select("snarl", "label", F.explode("children").alias("child")).distinct()
    allowed = seen.join(places.withColumnRenamed("site", "snarl"), ["snarl", "label"]).groupBy("snarl", "child").agg(F.sort_array(F.collect_set("idx")).alias("allowed"))
    cyclic = snarls.where("kind = 'cyclic'").select("snarl", "entry", "exit")
    found = spans(boundary_hits(walks, snarls)) if found is None else found
    steps = span_steps(walks, found.join(cyclic.select("snarl"), "snarl", "left_semi")).select("walk", "snarl", F.explode("steps").alias("s"))
    cycles = steps.join(cyclic, "snarl").where("s.node <> entry and s.node <> exit").groupBy("snarl", "s.node").agg(F.count("*").alias("n"))
    return {"flat": flat_panel, "skeleton": skeleton_panel, "allowed": allowed, "cycles": cycles}


def broken_rules(snarls: DataFrame, flat: DataFrame, skeleton: DataFrame, allowed: DataFrame) -> DataFrame:
    """(snarl, rule) for every rule that a topology and its panel (see panel) break; no rows if all is well.

    Cyclic sites have neither alleles nor routes, others have alleles; only sites with children have routes; places of
    alleles and of routes have no gap; frequencies are finite, not negative and sum to more than 0; a child of a site of
    several routes names those it occurs on, all of them routes of its parent.
    """

    def facts(panel: DataFrame, name: str) -> DataFrame:
        f = F.col("frequency")
        bad = F.max(f.isNull() | F.isnan(f) | (f < 0) | (f == float("inf"))) | ~F.coalesce(F.sum(f) > 0, F.lit(False))
        gap = (F.min("idx") != 0) | (F.max("idx") + 1 != F.count("*")) | (F.countDistinct("idx") != F.count("*"))
        return panel.groupBy(F.col("site").alias("snarl")).agg(F.count("*").alias(name), bad.alias(f"{name}_bad"), gap.alias(f"{name}_gap"))

    routes = facts(skeleton, "routes")
    children = snarls.where("parent is not null").groupBy(F.col("parent").alias("snarl")).agg(F.count("*").alias("children"))
    named = allowed.select(F.col("snarl").alias("parent"), F.col("child").alias("snarl"), "allowed")
    of_parent = routes.select(F.col("snarl").alias("parent"), F.col("routes").alias("parent_routes"))
    site = snarls.select("snarl", "kind", "parent").join(facts(flat, "alleles"), "snarl", "left").join(routes, "snarl", "left")
    site = site.join(children, "snarl", "left").join(of_parent, "parent", "left").join(named, ["parent", "snarl"], "left")
    cyclic, has_routes, several = F.col("kind") == "cyclic", F.col("routes").isNotNull(), F.col("parent_routes") > 1
    rules = {
        "cyclic site with alleles": cyclic & F.col("alleles").isNotNull(),
        "cyclic site with routes": cyclic & has_routes,
        "site without alleles": ~cyclic & F.col("alleles").isNull(),
        "frequencies of alleles": F.col("alleles_bad"),
        "gap in alleles": F.col("alleles_gap"),
        "routes without children": ~cyclic & has_routes & F.col("children").isNull(),
        "frequencies of routes": F.col("routes_bad"),
        "gap in routes": F.col("routes_gap"),
        "child without routes of its parent": several & (F.coalesce(F.size("allowed"), F.lit(0)) <= 0),
        "unknown route of the parent": several & F.exists("allowed", lambda k: (k < 0) | (k >= F.col("parent_routes"))),
    }
    found = F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]), lambda r: r.isNotNull())
    return site.select("snarl", F.explode(found).alias("rule"))


def tree(snarls: DataFrame) -> DataFrame:
    """snarls with depth and path (ids from the root); refuses repeated ids, missing parents and cycles."""
    named = stored(snarls)
    if not named.groupBy("snarl").count().where("count > 1").isEmpty():
        raise TopologyError("an id occurs twice")
    if not named.where("parent is not null").join(named.select(F.col("snarl").alias("parent")), "parent", "left_anti").isEmpty():
        raise TopologyError("a parent is missing")
    level = stored(named.where("parent is null").withColumns({"depth": F.lit(0), "path": F.array("snarl")}))
    done = level
    while not level.isEmpty():
        up = level.select(F.col("snarl").alias("parent"), F.col("depth").alias("d"), F.col("path").alias("p"))
        level = stored(named.join(up, "parent").select(*named.columns, (F.col("d") + 1).alias("depth"), F.array_append("p", F.col("snarl")).alias("path")))
        done = done.unionByName(level)
    done = stored(done)
    if done.count() != named.count():
        raise TopologyError("parents form a cycle")
    return done


def feature_sites(snarls: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """The sites with the fewest features: snarl, site_kind, columns, depth, parent, feature_start, feature_end.

    snarls also has alleles and skeletons (counts). A leaf costs its alleles less one, a cyclic snarl 1; a snarl with
    children the lesser of its alleles less one and its skeletons less one with its children's costs, and it is
    decomposed where both are equal. Costs rise level by level, choices go down again; sites come in pre-order, those
    without a feature are left out. levels is tree(snarls) where it is there already.
    """
    nodes = stored((tree(snarls) if levels is None else levels).withColumns({"alleles": F.coalesce("alleles", F.lit(1)), "skeletons": F.coalesce("skeletons", F.lit(1))}))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    costs = None
    for depth in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if costs is None:
            below = here.select(F.col("snarl"), F.lit(None).cast("bigint").alias("kids"))
        else:
            below = costs.groupBy(F.col("parent").alias("snarl")).agg(F.sum("cost").alias("kids"))
        flat = F.col("alleles") - 1
        split = F.col("skeletons") - 1 + F.col("kids")
        joined = here.join(below, "snarl", "left")
        choice = F.when(F.col("kind") == "cyclic", "cyclic").when(F.col("kids").isNull(), "leaf").when(flat < split, "flat").otherwise("skeleton")
        cost = F.when(F.col("kind") == "cyclic", 1).when(F.col("kids").isNull(), flat).otherwise(F.least(flat, split)).cast("bigint")
        level = stored(joined.select("snarl", "parent", "depth", "path", "alleles", "skeletons", cost.alias("cost"), choice.alias("site_kind")))
        chosen = level if costs is None else chosen.unionByName(level)
        costs = level
    chosen = stored(chosen)
    # a site is used if all its ancestors are decomposed
    above = chosen.select("snarl", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("a")).join(chosen.select(F.col("snarl").alias("a"), F.col("site_kind").alias("k")), "a")
    closed = above.where("k <> 'skeleton'").select("snarl").distinct()
    columns = F.when(F.col("site_kind") == "cyclic", 1).when(F.col("site_kind") == "skeleton", F.col("skeletons") - 1).otherwise(F.col("alleles") - 1).cast("bigint")
    used = chosen.join(closed, "snarl", "left_anti").withColumn("columns", columns).where("columns > 0")
    from .graph import running_total
    from .index import with_rank

    ordered = stored(with_rank(used, "path", name="place"))
    ends = running_total(ordered, "place", "columns", "feature_end")
    return ordered.join(ends, "place").select("place", "snarl", "site_kind", "columns", "depth", "parent", (F.col("feature_end") - F.col("columns")).alias("feature_start"), "feature_end")


#: Sites whose tree is walked in one task (some 100 bytes each); a larger topology goes level by level over tables.
MOST_SITES = 200_000


def sites_at_once(snarls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As (tree(snarls), feature_sites(snarls)), for snarls with alleles and skeletons, by one walk over all of them."""
    kind = snarls.schema["snarl"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        rows = {r["snarl"]: {**r, "alleles": 1 if r["alleles"] is None else r["alleles"], "skeletons": 1 if r["skeletons"] is None else r["skeletons"]} for r in table.to_pylist()}
        problem = "an id occurs twice" if len(rows) < table.num_rows else None
        kids: dict = {}
        for k, r in rows.items():
            if r["parent"] is not None and r["parent"] not in rows:
                problem = problem or "a parent is missing"
            kids.setdefault(r["parent"], []).append(k)
        order = sorted(kids.get(None, []), reverse=True)
        waiting, order = [(k, 0, [k]) for k in order], []
        while waiting:  # pre-order: children by their ids
            k, depth, path = waiting.pop()
            rows[k].update(depth=depth, path=path)
            order.append(k)
            waiting += [(c, depth + 1, [*path, c]) for c in sorted(kids.get(k, []), reverse=True)]
        if len(order) < len(rows):
            problem = problem or "parents form a cycle"
        at, end = 0, 0
        for k in reversed(order):
            r, below = rows[k], kids.get(k)
            flat, split = r["alleles"] - 1, r["skeletons"] - 1 + sum(rows[c]["cost"] for c in below or [])
            if r["kind"] == "cyclic":
                r.update(cost=1, site_kind="cyclic", columns=1)
            elif not below:
                r.update(cost=flat, site_kind="leaf", columns=flat)
            else:
                r.update(cost=min(flat, split), site_kind="flat" if flat < split else "skeleton", columns=flat if flat < split else r["skeletons"] - 1)
        for k in order:
            r = rows[k]
            above = rows.get(r["parent"])
            r["open"] = above is None or (above["open"] and above["site_kind"] == "skeleton")
            if r["open"] and r["columns"] > 0:
                r.update(place=at, feature_start=end, feature_end=end + r["columns"])
                at, end = at + 1, end + r["columns"]
        found = [rows[k] for k in order] if problem is None else [{"snarl": None}]
        columns = {c: pa.array([r.get(c) for r in found], t) for c, t in types.items()}
        return pa.table({**columns, "problem": pa.array([problem] * len(found), pa.string())})

    one = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    types = {"snarl": one, "kind": pa.string(), "parent": one, "alleles": pa.int64(), "skeletons": pa.int64(), "depth": pa.int32(), "path": pa.list_(one), "place": pa.int64(), "site_kind": pa.string(), "columns": pa.int64(), "feature_start": pa.int64(), "feature_end": pa.int64()}
    schema = f"snarl {kind}, kind string, parent {kind}, alleles long, skeletons long, depth int, path array<{kind}>, place long, site_kind string, columns long, feature_start long, feature_end long, problem string"
    asked = snarls.select("snarl", "kind", F.col("parent").cast(kind).alias("parent"), F.col("alleles").cast("bigint").alias("alleles"), F.col("skeletons").cast("bigint").alias("skeletons"))
    whole = stored(asked.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: solve(t.drop_columns(["all"]) if "all" in t.column_names else t), schema))
    wrong = whole.where("problem is not null").first()
    if wrong is not None:
        raise TopologyError(wrong["problem"])
    levels = whole.select("snarl", "kind", "parent", "alleles", "skeletons", "depth", "path")
    return levels, whole.where("place is not null").select("place", "snarl", "site_kind", "columns", "depth", "parent", "feature_start", "feature_end")


def conditions(sites: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """(snarl, ancestor, allowed): the skeleton alleles of every ancestor that let a walk reach a site.

    nodes is tree() with skeletons; a parent of one skeleton allows its allele 0.
    """
    steps = sites.join(nodes.select("snarl", "path"), "snarl").select("snarl", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "ancestor"), "path")
    steps = steps.withColumn("child", F.get("path", F.col("i") + 1))
    pairs = allowed.select(F.col("snarl").alias("ancestor"), "child", F.col("allowed").alias("a"))
    counts = nodes.select(F.col("snarl").alias("ancestor"), F.coalesce("skeletons", F.lit(1)).alias("k"))
    joined = steps.join(counts, "ancestor").join(pairs, ["ancestor", "child"], "left")
    return joined.select("snarl", "ancestor", F.when(F.col("k") > 1, F.coalesce("a", F.array().cast("array<bigint>"))).otherwise(F.array(F.lit(0).cast("bigint"))).alias("allowed"))


def reached(asked: DataFrame, when: DataFrame, skeleton_calls: DataFrame, who: str = "walk") -> DataFrame:
    """The pairs asked(who, snarl) whose conditions are all met; skeleton_calls(who, snarl, idx)."""
    calls = skeleton_calls.select(who, F.col("snarl").alias("ancestor"), "idx")
    needed = when.groupBy("snarl").agg(F.count("*").alias("needed"))
    met = when.join(calls, "ancestor").where(F.array_contains("allowed", F.col("idx"))).groupBy(who, "snarl").agg(F.count("*").alias("met"))
    return asked.join(needed, "snarl", "left").join(met, [who, "snarl"], "left").where("needed is null or met = needed").select(who, "snarl")


def learned(walks: DataFrame, snarls: DataFrame) -> dict[str, DataFrame]:
    """What an encoding takes from a panel of walks: its labels and alleles, the sites with their features, conditions."""
    walks = stored(walks)
    spanned = stored(spans(boundary_hits(walks, snarls)))
    flat_labels, skeleton_labels = stored(flat_signatures(walks, snarls, spanned)), stored(skeleton_signatures(walks, snarls, spanned))
    found = panel_of(flat_labels, skeleton_labels, walks, snarls, spanned)
    found.update({k: stored(found[k]) for k in ("flat", "skeleton")})
    sizes = found["flat"].groupBy(F.col("site").alias("snarl")).agg(F.count("*").alias("alleles"))
    routes = found["skeleton"].groupBy(F.col("site").alias("snarl")).agg(F.count("*").alias("skeletons"))
    known = snarls.join(sizes, "snarl", "left").join(routes, "snarl", "left")
    if snarls.count() <= MOST_SITES:
        levels, sites = sites_at_once(known)
    else:
        known = stored(known)
        levels = tree(known)
        sites = stored(feature_sites(known, levels))
    when = stored(conditions(sites, levels, found["allowed"]))
    return {**found, "walks": walks, "flat_labels": flat_labels, "skeleton_labels": skeleton_labels, "sites": sites, "when": when}


def site_columns(sites: DataFrame, panel: DataFrame, *kinds: str) -> DataFrame:
    """(snarl, allele, feature): the features of the acyclic sites of some kinds."""
    from .alleles import dosage_columns

    columns = dosage_columns(panel).select(F.col("site").alias("snarl"), F.col("idx").alias("allele"), "column")
    return sites.where(F.col("site_kind").isin(*kinds)).join(columns, "snarl").select("snarl", "allele", (F.col("feature_start") + F.col("column")).alias("feature"))


def encoded(walks: DataFrame, snarls: DataFrame) -> DataFrame:
    """(walk, feature, value): the encoding of walks against their own panel; what is not traversed has no row.

    Ambiguous spans are counted as alleles of the panel but have no row here.
    """
    from .alleles import label_map

    known = learned(walks, snarls)
    sites, walks = known["sites"], known["walks"]

    def calls(labels: DataFrame) -> DataFrame:
        named = labels.select(F.col("snarl").alias("site"), F.col("walk").alias("hap"), "label")
        met = named.where(F.col("label") != AMBIGUOUS).join(label_map(named), ["site", "label"])
        return met.select(F.col("hap").alias("walk"), F.col("site").alias("snarl"), "idx")

    routes = stored(calls(known["skeleton_labels"]))

    def one_hot(called: DataFrame, columns: DataFrame) -> DataFrame:
        used = called.join(reached(called.select("walk", "snarl"), known["when"], routes), ["walk", "snarl"])
        return used.join(columns, "snarl").select("walk", "feature", (F.col("idx") == F.col("allele")).cast("double").alias("value"))

    copies = repeat_counts(walks, snarls)
    looped = copies.join(reached(copies.select("walk", "snarl"), known["when"], routes), ["walk", "snarl"]).join(sites.where("site_kind = 'cyclic'"), "snarl")
    flat = one_hot(calls(known["flat_labels"]), site_columns(sites, known["flat"], "leaf", "flat"))
    split = one_hot(routes, site_columns(sites, known["skeleton"], "skeleton"))
    return flat.unionByName(split).unionByName(looped.select("walk", F.col("feature_start").alias("feature"), F.col("copies").cast("double").alias("value")))


def grid(cells: DataFrame, who: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells (walk, feature, value) as a whole matrix, null where there is none: for few walks only, by its very size."""
    features = sites.select(F.explode(F.sequence("feature_start", F.col("feature_end") - 1)).alias("feature"))
    return who.join(features, F.lit(True)).join(cells, [*who.columns, "feature"], "left")


def flat_parts(panel: DataFrame) -> DataFrame:
    """(site, idx, node): the nodes of the flat alleles of panel(site, label, idx); pooled and reserved labels name none."""
    return panel.select("site", "idx", F.explode(signature_nodes(F.col("label"))).alias("node"))


def skeleton_parts(panel: DataFrame) -> DataFrame:
    """(site, idx, node, child): the nodes and ``{child}`` parts of skeleton alleles, as skeleton_scores takes them."""
    named = panel.where(~F.col("label").isin(OTHER, MISSING)).select("site", "idx", F.explode(F.split("label", r"[|,]")).alias("part"))
    child = F.when(named["part"].rlike(r"^\{.+\}$"), F.expr("substring(part, 2, length(part) - 2)"))
    node = F.when(child.isNull(), F.regexp_extract("part", "^([0-9]+)[+-]$", 1).try_cast("bigint"))
    return named.select("site", "idx", node.alias("node"), child.alias("child")).where("node is not null or child is not null")


def chosen(asked: DataFrame, scores: DataFrame, panel: DataFrame, parts: DataFrame) -> DataFrame:
    """(individual, site, idx) of asked(individual, site): the allele of the largest mean, the first of several.

    Where no mean is positive, it is the first allele that names a part, and OTHER where none does; a site with neither
    has no row.
    """
    best = scores.where("mean > 0").groupBy("individual", "site").agg(F.max_by("idx", F.struct("mean", -F.col("idx"))).alias("best"))
    return asked.join(best, ["individual", "site"], "left").join(first_choice(panel, parts), "site").select("individual", "site", F.coalesce("best", "first").alias("idx"))


def first_choice(panel: DataFrame, parts: DataFrame) -> DataFrame:
    """(site, first): the first allele with a part, or else OTHER."""
    named = parts.groupBy("site").agg(F.min("idx").alias("named"))
    other = panel.where(F.col("label") == OTHER).select("site", F.col("idx").alias("other"))
    return named.join(other, "site", "full").select("site", F.coalesce("named", "other").alias("first"))


def shared_out(asked: DataFrame, scores: DataFrame, panel: DataFrame, parts: DataFrame) -> DataFrame:
    """(individual, site, idx, p) of asked(individual, site): means normalized in a site; 1 for the choice where all are 0."""
    pair = ["individual", "site"]
    positive = scores.where("mean > 0").join(asked, pair, "left_semi")
    shares = positive.select(*pair, "idx", (F.col("mean") / F.sum("mean").over(Window.partitionBy(*pair))).alias("p"))
    rest = asked.join(positive.select(*pair).distinct(), pair, "left_anti").join(first_choice(panel, parts), "site")
    return shares.unionByName(rest.select(*pair, F.col("first").alias("idx"), F.lit(1.0).alias("p")))


def flat_cells(asked: DataFrame, values: DataFrame, panel: DataFrame, parts: DataFrame, columns: DataFrame) -> DataFrame:
    """(individual, feature, value) of asked(individual, site, hard) by flat alleles: 1 for the chosen() allele of the
    hard ones, the shares of shared_out() over informative() nodes for the others, 0 for all other columns.

    What an individual has of a site's nodes is one row, a site's alleles and columns are another. Scores of all alleles
    and the cells arise from the two where they meet, so neither is ever exchanged.
    """
    from .alleles import SENT, informative

    columns = stored(columns)
    mine = columns.select(F.col("snarl").alias("site")).distinct()
    parts = stored(parts.join(mine, "site", "left_semi"))
    sent = F.broadcast if parts.count() + columns.count() <= SENT else lambda side: side

    def lists(rows: DataFrame, name: str) -> DataFrame:
        each = rows.groupBy("site", "idx").agg(F.collect_list("node").alias("nodes"))
        return each.groupBy("site").agg(F.collect_list(F.struct("idx", "nodes")).alias(name))

    facts = columns.groupBy(F.col("snarl").alias("site")).agg(F.collect_list(F.struct(F.col("allele").alias("idx"), "feature")).alias("columns"))
    facts = facts.join(lists(parts, "all_nodes"), "site", "left").join(lists(informative(parts), "own_nodes"), "site", "left").join(first_choice(panel, parts), "site", "left")
    met = values.join(sent(parts.select("site", "node").distinct()), "node")
    has = met.groupBy("individual", "site").agg(F.map_from_entries(F.collect_list(F.struct("node", "value"))).alias("at"))
    rows = asked.join(has, ["individual", "site"], "left").join(sent(stored(facts)), "site")

    def means(name: str) -> Column:
        total = lambda a: F.aggregate(a["nodes"], F.lit(0.0), lambda s, n: s + F.coalesce(F.try_element_at("at", n), F.lit(0.0)))
        scored = F.transform(name, lambda a: F.struct((total(a) / F.size(a["nodes"])).alias("mean"), a["idx"].alias("idx")))
        return F.filter(scored, lambda m: m["mean"] > 0)

    best = F.array_max(F.transform(means("all_nodes"), lambda m: F.struct(m["mean"].alias("mean"), (-m["idx"]).alias("neg"))))
    shares = F.when(~F.col("hard"), F.map_from_entries(F.transform(means("own_nodes"), lambda m: F.struct(m["idx"], m["mean"]))))
    rows = rows.select("individual", "columns", F.coalesce(F.when(F.col("hard"), -best["neg"]), "first").alias("pick"), shares.alias("shares"))
    total = F.aggregate(F.map_values("shares"), F.lit(0.0), lambda a, m: a + m)
    # columns come apart above the scores, which are so taken once a row
    cells = rows.select("individual", "pick", "shares", F.when(F.size("shares") > 0, total).alias("total"), F.inline("columns"))
    share = F.coalesce(F.try_element_at("shares", F.col("idx")), F.lit(0.0)) / F.col("total")
    value = F.when(F.col("total").isNotNull(), share).otherwise((F.col("idx") == F.col("pick")).cast("double"))
    return cells.select("individual", "feature", value.alias("value")).where("value is not null")


def encoded_values(values: DataFrame, walks: DataFrame, snarls: DataFrame) -> DataFrame:
    """(individual, feature, value): node values(individual, node, value) encoded against a panel of walks.

    Values are those of alleles.node_values. A site has rows for an individual with a positive value at its entry and
    exit whose ancestors' best skeletons allow the site. Individuals whose values are all 0 or 1 get the best allele
    as 0 and 1; the others get shares of the alleles. A cyclic site has the largest value of its inner nodes, or of its
    boundary where that is 0.
    """
    from .alleles import hard_calls

    known, values = learned(walks, snarls), stored(values)
    sites = known["sites"]
    site = F.col("snarl").alias("site")
    at = stored(traversed(values, snarls))
    here = at.select("individual", site)
    flat, routes = known["flat"], known["skeleton"]
    named, route_parts = stored(flat_parts(flat)), stored(skeleton_parts(routes))
    children = at.select("individual", F.col("snarl").cast("string").alias("child"))
    route_scores = stored(skeleton_scores(values, route_parts, children))
    on_routes = here.join(routes.select("site").distinct(), "site", "left_semi")
    route_calls = stored(chosen(on_routes, route_scores, routes, route_parts))
    used = stored(reached(at.join(sites.select("snarl"), "snarl", "left_semi"), known["when"], route_calls.withColumnRenamed("site", "snarl"), "individual"))
    hard = hard_calls(values)
    asked = used.join(hard, "individual").select("individual", site, "hard")
    firm, soft = asked.where("hard").drop("hard"), asked.where("not hard").drop("hard")

    def cells(p: DataFrame, pairs: DataFrame, columns: DataFrame) -> DataFrame:
        settled = p.select("individual", "site").distinct()
        wide = pairs.join(settled, ["individual", "site"]).join(columns.withColumnRenamed("snarl", "site").withColumnRenamed("allele", "idx"), "site")
        return wide.join(p, ["individual", "site", "idx"], "left").select("individual", "feature", F.coalesce("p", F.lit(0.0)).alias("value"))

    def both(panel: DataFrame, parts: DataFrame, all_scores: DataFrame, soft_scores: DataFrame, *kinds: str) -> DataFrame:
        columns = stored(site_columns(sites, panel, *kinds))
        mine = columns.select(site).distinct()
        calls = chosen(firm.join(mine, "site", "left_semi"), all_scores, panel, parts).withColumn("p", F.lit(1.0))
        shares = shared_out(soft.join(mine, "site", "left_semi"), soft_scores, panel, parts)
        return cells(calls.unionByName(shares), asked.drop("hard"), columns)

    leaves = flat_cells(asked, values, flat, named, site_columns(sites, flat, "leaf", "flat"))
    split = both(routes, route_parts, route_scores, route_scores, "skeleton")
    ends = snarls.select("snarl", F.explode(F.array_distinct(F.array("entry", "exit"))).alias("node"))
    inner = cyclic_support(values, known["cycles"]).where("support > 0").withColumnRenamed("support", "inner")
    outer = cyclic_support(values, ends)
    looped = used.join(sites.where("site_kind = 'cyclic'"), "snarl").join(outer, ["individual", "snarl"]).join(inner, ["individual", "snarl"], "left")
    return leaves.unionByName(split).unionByName(looped.select("individual", F.col("feature_start").alias("feature"), F.coalesce("inner", "support").alias("value")))


def skeleton_scores(values: DataFrame, parts: DataFrame, children: DataFrame) -> DataFrame:
    """(individual, site, idx, mean) of skeleton alleles.

    parts(site, idx, node, child) has a row for each node or child of an allele; a child scores 1 if the individual
    carries it (children(individual, child)), else 0.
    """
    who = values.select("individual").distinct()
    sizes = parts.groupBy("site", "idx").agg(F.count("*").alias("size"))
    by_node = parts.where("node is not null").join(values, "node").select("individual", "site", "idx", "value")
    by_child = parts.where("child is not null").join(children, "child").join(who, "individual", "left_semi").select("individual", "site", "idx", F.lit(1.0).alias("value"))
    return by_node.unionByName(by_child).groupBy("individual", "site", "idx").agg(F.sum("value").alias("sum")).join(sizes, ["site", "idx"]).select("individual", "site", "idx", (F.col("sum") / F.col("size")).alias("mean"))


def cyclic_support(values: DataFrame, cycles: DataFrame) -> DataFrame:
    """(individual, snarl, support): the largest value of an inner node of cycles(snarl, node)."""
    return values.join(cycles, "node").groupBy("individual", "snarl").agg(F.max("value").alias("support"))


def traversed(values: DataFrame, snarls: DataFrame) -> DataFrame:
    """(individual, snarl) with a positive value at entry and exit."""
    ends = snarls.select("snarl", F.explode(F.array_distinct(F.array("entry", "exit"))).alias("node"))
    needed = ends.groupBy("snarl").agg(F.count("*").alias("needed"))
    met = values.where("value > 0").join(ends, "node").groupBy("individual", "snarl").agg(F.count("*").alias("met"))
    return met.join(needed, "snarl").where("met = needed").select("individual", "snarl")


def catalog(sites: DataFrame, snarls: DataFrame, alleles: DataFrame) -> DataFrame:
    """(feature_id, snarl, entry, exit, k, cyclic, parent_feature): one record for a site; k is 0 for cyclic sites."""
    parent = sites.select(F.col("snarl").alias("parent"), F.col("feature_start").alias("parent_feature"))
    ends = snarls.select("snarl", "entry", "exit")
    cyclic = F.col("site_kind") == "cyclic"
    joined = sites.join(ends, "snarl").join(parent, "parent", "left").join(alleles.select("snarl", "k"), "snarl", "left")
    return joined.select(F.col("feature_start").alias("feature_id"), "snarl", "entry", "exit", F.when(cyclic, 0).otherwise(F.coalesce("k", F.lit(0))).cast("bigint").alias("k"), cyclic.alias("cyclic"), "parent_feature")
