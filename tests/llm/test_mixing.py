import numpy as np
import pytest

from graphloom.llm import mixing as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, mass double")


def waterfill(sizes, weights, most=3.0):
    total, full = sum(sizes), [False] * len(sizes)
    while True:
        free = sum(w for w, f in zip(weights, full) if not f)
        share = (total - sum(most * s for s, f in zip(sizes, full) if f)) / free if free else 0
        above = [not f and w * share > most * s for s, w, f in zip(sizes, weights, full)]
        if not any(above):
            return [most * s if f else w * share for s, w, f in zip(sizes, weights, full)]
        full = [a or f for a, f in zip(above, full)]


def test_targets_and_totals(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (source, n) in enumerate((("a", 400), ("b", 20), ("ß", 700), (None, 60), ("Z", 3))):
        rows += [(1000 * k + i, "w " * int(rng.integers(1, 60)), source, 7, 0.5) for i in range(n)]
    rows += [(None, "w w", "a", 7, 0.5), (5, None, "b", 7, 0.5), (5, " \n", "b", 7, 0.5), (5, "w", "b", 7, 0.5), (5, "w", "b", 7, 0.5)]
    df = frame(spark, rows)
    out = M.copies(df).collect()
    assert len(out) == len(rows)
    order = ["Z", "a", "b", "ß", None]
    text_of = {s: sum(len((t or "").split()) for _, t, x, *_ in rows if x == s) for s in order}
    want = dict(zip([text_of[s] for s in order], waterfill([text_of[s] for s in order], [1, 2, 3, 1, 2])))
    taken = {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        assert abs(r["target"] - want[r["source_size"]]) < 1e-6
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["copies"] * r["size"]
    for size, words in taken.items():
        assert abs(words - want[size]) <= max(60, 0.02 * want[size]), (size, words, want[size])
    again = sorted(tuple(r) for r in M.copies(df).select("size", "copies", "target").collect())
    assert again == sorted((r["size"], r["copies"], r["target"]) for r in out)
    elsewhere = sorted(tuple(r) for r in M.copies(df.repartition(7)).select("id", "size", "copies", "target").collect() if r["id"] is not None)
    assert elsewhere == sorted((r["id"], r["size"], r["copies"], r["target"]) for r in out if r["id"] is not None)
    mixed = M.mix(df.coalesce(2))
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_no_words_and_empty(spark):
    blank = M.copies(frame(spark, [(1, "", "a", 0, 0.0), (2, None, None, 0, 0.0)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in blank] == [(0, 0.0, 0)] * 2
    assert M.copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("outlier", [0, 400, 100_000])
@pytest.mark.parametrize("p", [0.2, 0.5, 0.9])
def test_expectations_hold(p, outlier):
    size = np.array(sorted(np.random.default_rng(1).integers(1, 50, 40), reverse=True), float)
    hits, last = np.zeros(len(size)), []
    if outlier:
        size[0] = outlier
    for trial in range(600):
        mass = size * p
        settled, left = M.pivot(list(range(len(size))), size, mass, f"t{trial}")
        assert len(settled) + (left is not None) == len(size)
        last.append(0 if left is None else size[left])
        assert all(v in (0, 1) for v in settled.values())
        total = sum(size[i] * v for i, v in settled.items()) + (mass[left] if left is not None else 0)
        assert abs(total - size.sum() * p) < 1e-6
        for i, v in settled.items():
            hits[i] += v
        if left is not None:
            hits[left] += mass[left] / size[left]
    assert np.abs(hits / 600 - p).max() < 0.09 and (outlier or np.mean(last) < 15)


def test_many_rows_of_one_id_and_text(spark):
    df = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "'w w w' AS text", "if(id < 90000, 'a', 'b') AS source")
    out = M.copies(df).cache()
    assert out.count() == 100_000 and out.select("row").distinct().count() == 100_000
    for r in out.groupBy("source_size", "target").agg({"copies": "sum"}).collect():
        assert abs(3 * r["sum(copies)"] - r["target"]) <= 3
    names = M._named(df.selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "source", "3L AS size", "7L AS mark"))
    assert names.groupBy("source", "name").count().where("count > 1").count() == 0
    assert names.agg({"name": "max"}).first()[0] <= "7/99999"


def test_large_ids_beside_null(spark):
    ids = [2**53 + 1, None, 2**53 + 3]
    out = M.copies(spark.createDataFrame([(i, "x y z", "a") for i in ids], "doc_id long, text string, source string").coalesce(1))
    assert sorted((r["id"] for r in out.collect()), key=repr) == sorted(ids, key=repr)
    assert out.schema["id"].dataType.simpleString() == "bigint"
