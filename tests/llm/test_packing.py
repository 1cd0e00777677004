import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing as P
from graphloom.llm import tokens

SAMPLES = ["", "Hello, world!  It's 12 o'clock", "naïve — Ünïcode  \n\n\t x  ", "a" * 3000, "é" * 500, "  lead", "tail   ", "<|endoftext|> spelled", "1234567 x9", "'ll 're", "日本語 テスト 😀😀"]


@pytest.mark.parametrize("text", SAMPLES)
def test_ids_are_those_of_tokenizers(text):
    assert tokens.encode(text).tolist() == tokens.exact_encoder().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, database=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t\u3000\x1c'sdlv aB1-é", max_size=60))
def test_ids_of_any_text(text):
    assert tokens.encode(text).tolist() == tokens.exact_encoder().encode(text, add_special_tokens=False).ids


def test_ids_of_the_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    exact = tokens.exact_encoder().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(tokens.encode(t).tolist() == e.ids for t, e in zip(texts, exact))


@pytest.mark.parametrize("blank", [" ", "\n", " \n", "\u3000 "])
@pytest.mark.parametrize("rest", ["", "x", "-", "\x1cx", "1 " + " " * 20_000 + "end"])
def test_long_blank_runs(blank, rest):
    text = "it's" + blank * tokens.LONG + rest
    assert tokens.encode(text).tolist() == tokens.exact_encoder().encode(text, add_special_tokens=False).ids


def test_five_million_blanks():
    assert len(tokens.encode(" " * 5_000_000 + "x")) > 0 and len(tokens.encode("x" + " \n" * 2_500_000)) > 0


def test_plan_uses_what_is_there():
    rng = np.random.default_rng(2)
    hist = np.bincount(rng.integers(1, 2048, 20_000), minlength=2048)
    hist[700] += 5000
    slots, used, sequences = P.plan(hist)
    assert (used <= hist).all()
    lengths = defaultdict(int)
    for length, a, b, first, _ in slots:
        for s in range(first, first + b - a):
            lengths[s] += length
    assert len(lengths) == sequences and set(lengths.values()) == {2048}
    assert (used * np.arange(2048)).sum() > 0.7 * (np.minimum(hist, 60) * np.arange(2048)).sum()


def test_least_squares_is_near_the_best():
    hist = np.zeros(2048, int)
    hist[[1000, 1048, 24, 2000]] = 10, 6, 5, 5
    combos = P.combinations(hist)
    x = P.least_squares(hist, combos)
    a = np.array([[c.count(k) for c in combos] for k in (1000, 1048, 24, 2000)], float)
    gradient = a.T @ (a @ x - np.array([10, 6, 5, 5]))
    assert (x >= 0).all() and (gradient > -0.5).all() and np.abs(gradient[x > 0.01]).max() < 0.5


def test_every_id_lies_in_one_piece(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "qux", "ümläut", "42"], rng.integers(1, 1500)))) for i in range(120)]
    rows += [(None, "null id"), (900, "again"), (900, "again"), (500, None), (501, ""), (502, "z " * 9000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    out = P.pack(df).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokens.encode(t).tolist(), 1]
        want[i] += len(ids)
    got, sequences = Counter(), defaultdict(list)
    ids_of = {i: np.append(tokens.encode(t), np.uint32(1)).astype("<u4") for i, t in rows}
    for r in out:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids_of[r["doc_id"]])
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_ids_beside_null(spark):
    ids = [2**53 + 1, None, 2**53 + 3]
    out = P.pack(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").coalesce(1))
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(ids, key=repr)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 7


def test_padding_is_none_and_sequences_are_full(spark):
    """Against the independent bound: no packing of n tokens has fewer than ceil(n / 2048) sequences."""
    rng = np.random.default_rng(9)
    rows = [(i, "x " * int(rng.integers(0, 3000))) for i in range(300)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in out]
    total = sum(sizes)
    assert total == sum(len(tokens.encode(t)) + 1 for _, t in rows)
    assert sum(s == P.WINDOW for s in sizes) == total // P.WINDOW and all(s & (s - 1) == 0 for s in sizes)
