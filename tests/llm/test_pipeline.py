"""The pipeline's stages, each held against what it should do with planted rows."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, exact_dedup, simhash, tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import numpy as np

    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    clean = [" ".join(rng.choice(vocab, 60)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    near = " ".join(vocab)
    rows += [(100, clean[5].replace(" ", "  "), "en", "s1", 1), (101, near, "en", "s1", 1), (102, near.upper(), "en", "s2", 1), (103, None, None, None, None)]
    toxic = [" ".join([*rng.choice(vocab, 20), *rng.choice(["scum", "idiot"], 6)]) for _ in range(40)]
    rows += [(200 + i, t, "en", "s0", len(t)) for i, t in enumerate(toxic)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 1, 1) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(folder))
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted((r["doc_id"] for r in docs.collect()), key=repr)
    clean = set(range(60)) | {101, 103}
    assert not [i for i in seen["toxicity"] if i >= 200] and clean <= set(seen["toxicity"])
    assert 100 not in seen["exact_dedup"] and clean <= set(seen["exact_dedup"])
    assert set(seen["simhash_near_dedup"]) == clean
    assert set(seen["mixing"]) <= clean and max(seen["mixing"].count(i) for i in clean) <= 3
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "mixing")).collect()}
    total = sum(len(tokens.encode(texts[i])) + 1 for i in seen["mixing"])
    assert spark.read.parquet(str(tmp_path / "packing")).groupBy().sum("length").first()[0] == total


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


CLASHING = ["row", "row_", "id", "fp", "root", "digest", "first", "n", "copies", "copies_", "__mix_copies", "__mix_row", "__exact_row", "__simhash_row", "__toxicity_row", "score", "part", "name", "mark", "stays", "gone", "terms", "path", "at", "file_number", "_metadata"]


@pytest.mark.parametrize("k", range(4))
def test_decisions_keep_to_their_rows(spark, folder, tmp_path, k):
    """Another division into tasks after the decisions changes nothing, and columns of any name come through."""
    texts = [f"text number {i % 40} " + " ".join(f"w{i % 40}x{j}" for j in range(30)) + (" scum idiot" * 4 if i % 40 < 10 else "") for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    docs.repartition(8).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(i, 1, int(i < 10)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    results = []
    for later in ("1", "8"):
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            out = stage(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
            spark.conf.set("spark.sql.files.minPartitionNum", later)
            rows = out.collect()
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert out.columns == docs.columns
        for r in rows:
            assert r["text"] == texts[r["doc_id"]] and all(r[c] == f"{c}{r['doc_id']}" for c in CLASHING)
        results.append(sorted(r["doc_id"] for r in rows))
    assert results[0] == results[1]
    if name == "toxicity":
        assert results[0] == [i for i in range(80) if i % 40 >= 10]
    elif name == "exact_dedup":
        assert results[0] == list(range(40))
    elif name == "simhash_near_dedup":
        assert len({i % 40 for i in results[0]}) == len(results[0]) and set(results[0]) <= set(range(40))


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_pipeline(docs):
    """What the stages before mixing keep, from the definitions alone: a toxic word, equal texts, near fingerprints."""
    kept = [d for d in docs if not {"scum", "idiot"} & set((d[1] or "").split())]
    first = {}
    for i, t in sorted(kept, key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    prints = [(simhash.fingerprint(t), i) for i, t in first.values()]
    root = {i: i for _, i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in prints:
        for b, y in prints:
            if bin(a ^ b).count("1") <= 2:
                x_, y_ = sorted((find(x), find(y)))
                root[y_] = x_
    return {find(i) for i in root}


def test_against_brute_force(spark, folder, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(folder / "documents.parquet")).collect()]
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r["doc_id"] for r in docs.collect()} == brute_pipeline(rows)
    packed = corpus_pipeline.run(spark, str(folder))
    sizes = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in sizes} <= brute_pipeline(rows)
    texts = dict(rows)
    for r in sizes:
        assert r["doc_tokens"] == len(tokens.encode(texts[r["doc_id"]])) + 1 and r["n"] % r["doc_tokens"] == 0 and r["n"] <= 3 * r["doc_tokens"]


def test_rows_without_a_place_of_their_own(spark, tmp_path):
    """Frames that repeat or lose the places of a scan are numbered and written instead."""
    rows = [(i, f"text {i // 2}") for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    plain.repartition(4).write.parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    place = lambda df: common._stands(df) and common._placed(df, "row") is not None
    chosen = scan.where("doc_id < 30").select("doc_id", F.upper("text").alias("text"))
    assert place(scan) and place(chosen) and common._placed(chosen, "row").count() == 30
    unions = (scan.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), scan.union(scan), scan.union(plain), plain.union(scan), scan.join(plain, ["doc_id", "text"]))
    for docs in (plain, *unions):
        assert not place(docs)
        kept, row = common.numbered(docs)
        assert kept.select(row).distinct().count() == docs.count() and kept.drop(row).columns == docs.columns
        assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(docs).collect()) == list(range(0, 40, 2))


RANDOM = {
    "filter": lambda docs: docs.where(F.rand(7) < 0.5),
    "sample": lambda docs: docs.sample(0.5, seed=3),
    "column": lambda docs: docs.withColumn("k", F.rand(1)).where("k < 0.5"),
    "distinct": lambda docs: docs.dropDuplicates(["text"]),
    "limit": lambda docs: docs.limit(150),
    "order": lambda docs: docs.orderBy(F.rand(2)).limit(200),
}


@pytest.mark.parametrize("kind", RANDOM)
def test_random_frames_are_drawn_once(spark, tmp_path, kind):
    """Whatever becomes of the division into tasks, a stage decides on one draw and returns rows of that draw."""
    texts = [" ".join(f"w{i % 40}x{j}" for j in range(30)) for i in range(400)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "docs"))
    for stage in (exact_dedup.drop_duplicates, simhash.keep_one):
        draws = []
        try:
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            out = stage(RANDOM[kind](spark.read.parquet(str(tmp_path / "docs"))))
            for parts in ("1", "8", "3"):
                spark.conf.set("spark.sql.files.minPartitionNum", parts)
                draws.append(sorted((r["doc_id"], r["text"]) for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert draws[0] == draws[1] == draws[2] and draws[0]
        found = [t for _, t in draws[0]]
        assert len(set(found)) == len(found) and all(texts[i] == t for i, t in draws[0])
