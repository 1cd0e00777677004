import shutil
from collections import Counter

from graphloom.llm import token_rollup as R
from graphloom.llm import tokens

SCHEMA = "source string, lang string, tokenizer string, old_tokens long, tokens long, docs string"


def totals(spark, state):
    return {tuple(r)[:3]: (r["docs"], r["tokens"]) for r in R.totals(spark, state).collect()}


def test_signed_batches_are_idempotent(spark, tmp_path):
    state = str(tmp_path / "state")
    assert totals(spark, state) == {}
    rows = [("a", "en", "v1", 4, 5, "x"), ("a", "en", "v1", 7, 7, "x"), ("a", "en", "v1", 7, 7, "x"), (None, None, "v1", None, None, "x"), ("b", "de", "v2", 1, 9, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert R.commit(state, "day/1", R.inserts(df)) and not R.commit(state, "day/1", R.inserts(df))
    first = {("a", "en", "v1"): (3, 19), (None, None, "v1"): (1, 0), ("b", "de", "v2"): (1, 9)}
    assert totals(spark, state) == first
    assert R.commit(state, "revise", R.revisions(df.where("source = 'b'")))
    assert totals(spark, state)["b", "de", "v2"] == (1, 17)
    assert R.commit(state, "delete", R.deletes(df.where("tokens = 7").limit(1))) and R.commit(state, "none", R.inserts(df.limit(0)))
    assert totals(spark, state)["a", "en", "v1"] == (2, 12)
    R.commit(state, "rest", R.deletes(df.where("source is null")))
    assert (None, None, "v1") not in totals(spark, state)
    before = totals(spark, state)
    assert R.compact(spark, state) == 5 and R.compact(spark, state) == 0
    assert totals(spark, state) == before and len(list((tmp_path / "state").iterdir())) == 1
    # a replay of an old batch after compaction counts once, and new batches go on
    assert not R.commit(state, "day/1", R.inserts(df)) and totals(spark, state) == before
    assert R.commit(state, "day/2", R.inserts(df.where("source = 'b'"))) and totals(spark, state)["b", "de", "v2"] == (2, 26)
    after = totals(spark, state)
    assert R.compact(spark, state) == 1 and totals(spark, state) == after
    assert not R.commit(state, "day/1", R.inserts(df)) and not R.commit(state, "day/2", R.inserts(df))


def test_a_compaction_stopped_before_its_deletions_counts_once(spark, tmp_path):
    state, kept = tmp_path / "state", tmp_path / "kept"
    df = spark.createDataFrame([("a", "en", "v1", 0, 5, "x")], SCHEMA)
    R.commit(str(state), "b", R.inserts(df))
    shutil.copytree(state, kept)
    R.compact(spark, str(state))
    shutil.copytree(kept / "batch-b", state / "batch-b")
    assert totals(spark, str(state)) == {("a", "en", "v1"): (1, 5)} and not R.commit(str(state), "b", R.inserts(df))
    R.compact(spark, str(state))
    assert not (state / "batch-b").exists() and totals(spark, str(state)) == {("a", "en", "v1"): (1, 5)}


def test_two_writers_of_one_name(spark, tmp_path):
    state = str(tmp_path / "state")
    df = spark.createDataFrame([("a", "en", "v1", 0, 5, "x")], SCHEMA)
    assert R._publish(spark, state, R._batch("b"), {"deltas": R.reduced(R.inserts(df))})
    assert not R._publish(spark, state, R._batch("b"), {"deltas": R.reduced(R.inserts(df))})
    assert totals(spark, state) == {("a", "en", "v1"): (1, 5)} and [p.name for p in (tmp_path / "state").iterdir()] == ["batch-b"]


def test_a_lost_batch_is_written_anew(spark, tmp_path):
    state = tmp_path / "state"
    df = spark.createDataFrame([("a", "en", "v1", 0, 5, "x")], SCHEMA)
    R.commit(str(state), "b", R.inserts(df))
    (state / "batch-b").rename(state / "_staged-0")
    assert totals(spark, str(state)) == {}
    assert R.commit(str(state), "b", R.inserts(df)) and totals(spark, str(state)) == {("a", "en", "v1"): (1, 5)}


def test_query_against_brute_force(spark, tmp_path):
    rows = [(1, "Hello wörld", "en", "s"), (2, None, "en", "s"), (3, " ", None, None), (4, "Hello wörld", "en", "s"), (5, "x y z", "de", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r)[:3]: (r["docs"], r["tokens"]) for r in R.op2(spark, str(tmp_path)).collect()}
    want_docs, want_tokens = Counter(), Counter()
    for _, text, lang, source in rows:
        n = len((text or "").split())
        for version, count, counts in (("words", n, n > 0), ("byte_bpe_50k", len(tokens.encode(text)), True)):
            want_docs[source, lang, version] += counts
            want_tokens[source, lang, version] += count
    assert got == {k: (want_docs[k], want_tokens[k]) for k in want_docs if want_docs[k] or want_tokens[k]}
