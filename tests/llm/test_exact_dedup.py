import hashlib
import re

from graphloom.llm import exact_dedup as D

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (5, None), (4, ""), (6, "x"), (6, "x"), (7, "y" * 200_000), (8, " "), (9, "\n\n"), (10, "é é")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, n long, digest string")
    got = D.exact_groups(df, **options).collect()
    assert sum(r["kept"] for r in got) == len({bytes(r["digest"]) for r in got})
    return sorted(((r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got), key=repr)


def test_groups(spark):
    assert found(spark, ROWS) == brute(ROWS)


def test_heavy_and_light_agree(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)] + [(i, "hot") for i in range(100, 140)]
    assert found(spark, rows, support=0.3) == brute(rows) == found(spark, rows, support=0.01)


def test_drop_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (2, "a  b", "l"), (2, "a b", "m"), (3, "c", "n")], "doc_id long, text string, `group size` string").repartition(1)
    got = D.drop_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.exact_groups(df).count() == 0 and D.drop_duplicates(df).count() == 0
