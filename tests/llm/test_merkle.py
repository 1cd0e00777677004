import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        out.append((nodes[first:at], nodes[at + 1 : first + 3]))
        at //= 3
    return out


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, kept = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        kept.append(mine)
        trees.append(up([leaf_of(*r) for r in mine]))
    top = up([t[-1][0] for t in trees])
    out = []
    for k, (mine, levels) in enumerate(zip(kept, trees)):
        for at, r in enumerate(mine):
            path = siblings(levels, at) + siblings(top, k)
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            node = leaf_of(*changed)
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in (*before, *after)))
            out.append((r[0], levels[0][at], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    texts = ["one\ntwo", "plain", "", None, "ümläut\n日本", "x" * 50_000 + "\n"]
    rows = [(i, ["a", "b", "Z", None, "", "é"][min(i * i % 11, 5)], ["en", None][i % 2], [i, None][i % 3 == 0], texts[i % len(texts)]) for i in range(n)]
    return rows


@pytest.fixture
def query(spark, tmp_path):
    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        df.select("*", F.lit(1).alias("leaf"), F.lit(2).alias("at"), F.lit(3).alias("tree")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        got = M.op12(spark, str(tmp_path))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted(map(tuple, got.collect()), key=repr)

    return run


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 95])
def test_against_brute_force(query, n):
    assert query(rows_of(n)) == brute(rows_of(n))


def test_repeated_and_null_ids(query):
    rows = [(7, "a", "en", 1, "same\n"), (7, "a", "en", 1, "same\n"), (7, "a", "en", 1, "other"), (None, "a", None, None, "n\n"), (None, None, None, None, None), (2**60, "b", "en", 1, "")]
    assert query(rows) == brute(rows)


def test_many_blocks(spark):
    """Blocks of 9 leaves: traversals of several levels, and trees of one block beside trees of many."""
    rows = [(i, f"s{min(i % 40, 7)}", "en", i, f"text {i}\n") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    want = brute(rows)
    for depth in (1, 2):
        got = M.manifest(df, depth=depth, claims={"own": M.digest(*(F.col(c) for c in M.FIELDS))})
        got = got.withColumn("again", M.folded(F.col("own"), F.col("proof"))).collect()
        assert sorted((r["id"], r["leaf"], r["subroot"], r["root"]) for r in got) == sorted(w[:4] for w in want)
        assert all(r["again"] == r["root"] for r in got)


def test_one_changed_byte_is_found(spark):
    df = spark.createDataFrame([(i, "a", "en", 1, "x" * i) for i in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    got = M.manifest(df, claims={"claim": F.sha2(F.lit("forged"), 256)}).withColumn("again", M.folded(F.col("claim"), F.col("proof")))
    assert got.where("again = root").isEmpty()


def test_empty(query):
    assert query([]) == []


def test_postorder_appends_siblings():
    root, proofs = M.postorder(list("abcd"), 2)
    assert root == h(h("a", "b", "c"), h("d"))
    assert proofs[1] == [{"before": "a", "after": "c"}, {"before": "", "after": h("d")}]
    assert proofs[3] == [{"before": "", "after": ""}, {"before": h("a", "b", "c"), "after": ""}]
