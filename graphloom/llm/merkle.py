"""A Merkle manifest of documents: a digest for each row, a tree for each source, one root, and every row's proof.

The leaves of a source, in the order of their ids, are cut into aligned blocks of FAN ** DEPTH. A task walks a block's
tree in postorder: a call returns the digest of its subtree and, while it unwinds, appends the siblings it saw to the
proofs of the leaves it holds. The roots of aligned blocks are the leaves of another such traversal, dealt out again,
until each source has one root; the roots of the sources are then one more tree. What a traversal finds above a block
holds for all its leaves and is joined to them by block.

Texts are read once, for the digests; places come from ranges, counts and offsets, so no task sorts a source. A tree
of n leaves has a proof of about 3 ** -1 log n levels of two digests, which is what travels with a row.

Cases: a null field counts as ``-``, an empty one as ``0:``; a null source is a tree of its own, before the others;
null ids come before other ids, and rows of one id are ordered by their digest, so that copies may trade places but no
result changes; a very long text is hashed by Spark where it is read; an empty table gives no rows; other columns are
ignored. A null id has no checksum and is not tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import with_rank
from .common import table, written

FAN = 3
#: Levels of a block: 3 ** 8 leaves at most, with proofs of some 1 KB each.
DEPTH = 8
#: Places of a source that are joined to it together.
STRETCH = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<before:string,after:string>>"
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int, fan: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while fan**levels < n:
        levels += 1
    return levels


def postorder(leaves: list[str], levels: int, fan: int = FAN) -> tuple[str, list[list[dict[str, str]]]]:
    """The root, levels above the leaves, and each leaf's siblings from the lowest level up."""
    proofs: list[list[dict[str, str]]] = [[] for _ in leaves]

    def visit(start: int, level: int) -> str:
        if not level:
            return leaves[start]
        width = fan ** (level - 1)
        starts = range(start, min(start + fan * width, len(leaves)), width)
        below = [visit(s, level - 1) for s in starts]
        for k, s in enumerate(starts):
            step = {"before": "".join(below[:k]), "after": "".join(below[k + 1 :])}
            for leaf in range(s, min(s + width, len(leaves))):
                proofs[leaf].append(step)
        return joined(below)

    return visit(0, levels), proofs


def _walk(fan: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block.column("leaves")[0].as_py()
        root, proofs = postorder(block.column("node").to_pylist(), min(depth, height(n, fan)), fan)
        return pa.table(
            {
                "tree": block.column("tree"),
                "at": block.column("at"),
                "block": block.column("block"),
                "proof": pa.array(proofs, _STEP),
                "top": pa.array([root] * len(block), pa.string()),
            }
        )

    return run


def traverse(leaves: DataFrame, crown: Callable[[DataFrame], DataFrame], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(tree, at, proof, subroot, root) for leaves(tree, at, node, leaves), whose at runs from 0 to below leaves.

    crown takes each tree's root (tree, node) and returns (tree, higher, root): what lies above it. It is joined where
    every tree has come down to one block, and each block's findings by block, so that no tree is one task's work.
    """
    size = fan**depth
    dealt = leaves.select("tree", "at", "node", "leaves", F.expr(f"at div {size}").alias("block"))
    walked = written(dealt.groupBy("tree", "block").applyInArrow(_walk(fan, depth), f"tree long, at long, block long, proof {STEPS}, top string"))
    blocks = walked.where(F.col("at") == F.col("block") * size).select("tree", F.col("block").alias("at"), F.col("top").alias("node"))
    if blocks.where("at > 0").isEmpty():
        above = crown(blocks.select("tree", "node")).select("tree", "higher", "root")
        return walked.join(above, "tree").select("tree", "at", F.concat("proof", "higher").alias("proof"), F.col("top").alias("subroot"), "root")
    count = leaves.where("at = 0").select("tree", F.expr(f"(leaves + {size - 1}) div {size}").alias("leaves"))
    above = traverse(blocks.join(count, "tree"), crown, fan, depth).select("tree", F.col("at").alias("block"), F.col("proof").alias("higher"), "subroot", "root")
    return walked.join(above, ["tree", "block"]).select("tree", "at", F.concat("proof", "higher").alias("proof"), "subroot", "root")


def bare(roots: DataFrame) -> DataFrame:
    """The crown of trees with nothing above them."""
    return roots.select("tree", F.expr(f"cast(array() as {STEPS})").alias("higher"), F.col("node").alias("root"))


def one_tree(fan: int, depth: int) -> Callable[[DataFrame], DataFrame]:
    """The crown in which the roots, in the order of their trees, are the leaves of one more tree."""

    def run(roots: DataFrame) -> DataFrame:
        leaves = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "node", F.lit(roots.count()).cast("long").alias("leaves"))
        return traverse(leaves, bare, fan, depth).select(F.col("at").alias("tree"), F.col("proof").alias("higher"), "root")

    return run


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", claims: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """id, source, leaf, proof (siblings from the leaf up to the root), subroot, root and claims, further columns.

    Claims are columns over docs that are to be held against the proof, such as digests of what another copy holds.
    """
    claims = claims or {}
    leaves = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), digest(*(F.col(c) for c in columns)).alias("leaf"), *(c.alias(k) for k, c in claims.items())))
    ranked = with_rank(leaves, F.asc_nulls_first("source"), F.asc_nulls_first("id"), "leaf", name="place")
    trees = with_rank(ranked.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("leaves")), "first", name="tree")
    # a source's places follow one another; they are joined in stretches, so that no source is one task's work
    stretch = trees.select("tree", "first", "leaves", F.explode(F.expr(f"sequence(first div {STRETCH}, (first + leaves - 1) div {STRETCH})")).alias("stretch"), F.col("source").alias("of"))
    meets = (F.expr(f"place div {STRETCH}") == F.col("stretch")) & F.col("source").eqNullSafe(F.col("of"))
    placed = written(ranked.join(stretch, meets).withColumn("at", F.col("place") - F.col("first")).drop("of", "first", "place", "stretch"))
    found = traverse(placed.select("tree", "at", F.col("leaf").alias("node"), "leaves"), one_tree(fan, depth), fan, depth)
    return placed.join(found, ["tree", "at"]).drop("tree", "at", "leaves")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    other = digest(*(F.col(c) for c in FIELDS[:-1]), text)
    found = manifest(docs, claims={"claim": other})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS entry
  FROM range(256) AS t(b)
), steps AS (
  SELECT list(entry ORDER BY b) AS step FROM bytes
), read_docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, steps
), digests AS (
  SELECT doc_id, source,
    sha256(i || s || l || n || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(i || s || l || n || coalesce(strlen(other) || ':' || other, '-')) AS claim
  FROM (SELECT doc_id, source, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS i, coalesce(strlen(source) || ':' || source, '-') AS s,
      coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n FROM read_docs)
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests
), nodes AS (
  SELECT 0 AS level, tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 3
), tops AS (
  SELECT 0 AS level, tree AS pos, node, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM tops WHERE n > 1 GROUP BY level, pos // 3
), runs AS (
  SELECT level, tree, a.pos,
    coalesce((SELECT string_agg(b.node, '' ORDER BY b.pos) FROM nodes AS b WHERE b.level = a.level AND b.tree = a.tree AND b.pos // 3 = a.pos // 3 AND b.pos < a.pos), '') AS before,
    coalesce((SELECT string_agg(b.node, '' ORDER BY b.pos) FROM nodes AS b WHERE b.level = a.level AND b.tree = a.tree AND b.pos // 3 = a.pos // 3 AND b.pos > a.pos), '') AS after
  FROM nodes AS a WHERE n > 1
), top_runs AS (
  SELECT level, a.pos,
    coalesce((SELECT string_agg(b.node, '' ORDER BY b.pos) FROM tops AS b WHERE b.level = a.level AND b.pos // 3 = a.pos // 3 AND b.pos < a.pos), '') AS before,
    coalesce((SELECT string_agg(b.node, '' ORDER BY b.pos) FROM tops AS b WHERE b.level = a.level AND b.pos // 3 = a.pos // 3 AND b.pos > a.pos), '') AS after
  FROM tops AS a WHERE n > 1
), path AS (
  SELECT l.tree, l.pos, 0 AS upper, r.level, r.before, r.after FROM leaves AS l JOIN runs AS r ON r.tree = l.tree AND r.pos = l.pos // pow(3, r.level)::BIGINT
  UNION ALL
  SELECT l.tree, l.pos, 1, r.level, r.before, r.after FROM leaves AS l JOIN top_runs AS r ON r.pos = l.tree // pow(3, r.level)::BIGINT
), proofs AS (
  SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY upper, level)) AS proof_sha256,
    list({'before': before, 'after': after} ORDER BY upper, level) AS steps
  FROM path GROUP BY tree, pos
), folds AS (
  SELECT tree, pos, 0 AS k, claim AS node FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, k + 1, sha256(steps[k + 1].before || f.node || steps[k + 1].after)
  FROM folds AS f JOIN proofs AS p ON p.tree = f.tree AND p.pos = f.pos WHERE k < len(steps)
), answers AS (
  SELECT l.doc_id, l.leaf, s.node AS subroot, (SELECT node FROM tops WHERE n = 1) AS root,
    coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root
  FROM leaves AS l
  JOIN nodes AS s ON s.tree = l.tree AND s.n = 1
  LEFT JOIN proofs AS p ON p.tree = l.tree AND p.pos = l.pos
  JOIN folds AS f ON f.tree = l.tree AND f.pos = l.pos AND f.k = coalesce(len(p.steps), 0)
)
SELECT *, folded_root = root AS verified FROM answers
"""
