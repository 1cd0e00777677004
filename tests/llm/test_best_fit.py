import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import best_fit as B

SAMPLES = ["", " \n\t", "Hello, WORLD!  It's 12 o'clock", "naïve — Ünïcode \x0b x", "a" * 3000, "<|endoftext|> spelled", "İstanbul ΣΑΣ　日本語 😀", "é ́x", None]


def exact(text):
    return [*B.encoder().encode(text or "", add_special_tokens=False).ids, B.END]


def of_texts(texts):
    flat, edges = B.Ids().texts(pa.array(texts, pa.string()))
    return [[*flat[a:b].tolist(), B.END] for a, b in zip(edges, edges[1:])]


def test_ids_are_those_of_tokenizers():
    assert of_texts(SAMPLES) == [exact(t) for t in SAMPLES]


@settings(max_examples=300, deadline=None, database=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" \n\t　\x1ć'sd aB1-éΣ", max_size=40) | st.text(alphabet=st.characters(max_codepoint=0x250), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    assert of_texts(texts) == [exact(t) for t in texts]


def test_ids_of_the_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert of_texts(texts) == [exact(t) for t in texts]


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 5)
    ids = B.Ids()
    for k in range(20):
        words = [f"w{j}" for j in range(k, k + 4)]
        assert ids.of(words) == [exact(w)[:-1] for w in words] and len(ids.known) <= 5


def problem(n, seed):
    return np.random.default_rng(seed).integers(1, B.WINDOW, n)


def check_grouping(lengths, bin_of):
    fill = np.bincount(bin_of, weights=lengths)
    assert len(bin_of) == len(lengths) and (bin_of >= 0).all() and fill.max() <= B.WINDOW


def test_crossover_moves_whole_bins():
    lengths, rng = problem(300, 1), np.random.default_rng(2)
    a, b = B.founders(lengths, rng)[1:3]
    child = B.crossover(lengths, a, b, rng)
    check_grouping(lengths, child)
    groups = lambda bins: {frozenset(np.flatnonzero(bins == k).tolist()) for k in np.unique(bins)}
    kept = groups(child) & groups(b.bin_of)
    assert len(kept) >= len(b.fill) // 5  # a quarter of them less those best fit topped up
    check_grouping(lengths, B.shaken(lengths, a, rng))


def test_best_fit_takes_the_fullest_bin_with_room():
    lengths = np.array([4000, 3000, 90, 1000, 4096])
    assert B.best_fit(lengths, np.array([0, 1, -1, -1, -1]), np.array([2, 3, 4])).tolist() == [0, 1, 0, 1, 2]


def test_evolution_beats_its_founders():
    rng = np.random.default_rng(3)
    lengths = rng.integers(700, 2000, 400)  # two to five in a sequence: best fit alone wastes much
    first = B.founders(lengths, np.random.default_rng(4))
    people = first
    for _ in range(5):
        people = B.evolved(lengths, people, rng)
    check_grouping(lengths, people[0].bin_of)
    assert len(people[0].fill) <= min(len(g.fill) for g in first)
    assert people[0].fitness > max(g.fitness for g in first)


def held(rows, out):
    want = {(i, t): exact(t) for i, t in rows}
    pieces, sequences = Counter(), defaultdict(list)
    for i, ids in ((i, want[i, t]) for i, t in rows):
        for p, s in enumerate(range(0, len(ids), B.WINDOW)):
            part = ids[s : s + B.WINDOW]
            pieces[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= B.WINDOW
    return len(sequences), sum(len(want[i, t]) for i, t in rows)


def best_fit_decreasing(lengths):
    lengths = np.array(lengths)
    return len(np.unique(B.best_fit(lengths, np.full(len(lengths), -1), np.argsort(-lengths, kind="stable"))))


def test_every_id_lies_in_one_piece(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "qux", "Ümläut", "42"], rng.integers(1, 2500)))) for i in range(150)]
    rows += [(None, "null id"), (900, "again"), (900, "again"), (500, None), (501, ""), (502, "z " * 9000), (503, "the " * 4096), (504, "the " * 4095), (2**53 + 1, "x")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, row int").repartition(3)
    got = B.pack(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", *["bigint"] * 5]
    sequences, tokens = held(rows, got.collect())
    assert sequences <= -(-tokens // B.WINDOW) + 1


def test_many_problems_waste_little(spark, monkeypatch):
    monkeypatch.setattr(B, "PROBLEM", 256)
    rng = np.random.default_rng(8)
    rows = [(i, "the " * int(rng.integers(0, 4096))) for i in range(1500)]
    sequences, tokens = held(rows, B.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sequences <= best_fit_decreasing([len(exact(t)) for _, t in rows]) * 1.01 and sequences >= -(-tokens // B.WINDOW)


@pytest.mark.parametrize("rows", [[], [(1, "the " * 4095)]])
def test_nothing_to_group(spark, rows):
    out = B.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
