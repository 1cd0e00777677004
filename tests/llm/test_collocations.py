import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import collocations as C
from graphloom.llm import splits

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def brute(rows, least, longest=4, covered=80, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                score, _, l, r = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
                kept.append((" ".join(p), a, l, r, score))
        kept.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(kept[:first])]
    return sorted(out)


def found(spark, rows, least, **more):
    df = spark.createDataFrame([(t, x, 0, 0) for x, t in rows], "text string, lang string, n long, block int").repartition(3)
    got = C.leading(C.phrases(df, least=least, **more).where("not dropped")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["The", "the", "of", "new", "york", "City", "a", "ü", "Ä", "日本", "x-y", "don't"]
    rows = []
    for k in range(120):
        parts = [rng.choice([*vocab, "new york city", "of the new"]) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "!"]) for _ in range(rng.randrange(1, 60))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(parts)))
    rows += [("en", None), (None, ""), ("fr", " \t\n.,;"), ("en", "again new york again new york"), ("en", "again new york again new york")]
    assert found(spark, rows, 4) == brute(rows, 4)
    assert found(spark, rows, 2) == brute(rows, 2)


def test_overlaps_and_repeats(spark):
    rows = [("en", "a " * 50), ("en", "b b b"), ("en", "b b b")]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_long_text_and_small_blocks(spark, monkeypatch):
    rows = [("en", "one two three four five " * 4000 + "one two"), ("de", "one two")]
    monkeypatch.setattr(splits, "LOT", 1000)
    assert found(spark, rows, 30) == brute(rows, 30)


def test_empty(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(None, None)], 2) == []


def test_products_beyond_64_bits(spark):
    a, both = 9_000_000_000_000_000_000, 18_000_000_000_000_000_001
    from pyspark.sql import functions as F

    row = spark.range(1).select(C._score(F.lit(a), F.lit(both - a).cast("decimal(20,0)") + F.lit(a)).alias("s")).first()
    assert row["s"] == 2_000_000 * a // both


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.none() | st.text(alphabet="aB É.,\n\t日", max_size=12), max_size=8))
def test_words_of_any_text(texts):
    text, piece, word = splits.words(pa.array(texts, pa.string()), C.KIND, lower=True)
    got = defaultdict(list)
    for t, p, w in zip(text.tolist(), piece.tolist(), word.to_pylist()):
        got[t, p].append(w)
    want = [(t, ws) for t, x in enumerate(texts) for ws in pieces_of(x) if ws]
    assert [(t, ws) for (t, _), ws in sorted(got.items())] == want


@pytest.mark.parametrize("size", [1, 5, 100])
def test_lots_hold_every_text_once(size):
    texts = pa.array(["abc", None, "", "d" * 50, "é", "f"])
    assert [k for a, b in splits.lots(texts, size) for k in range(a, b)] == list(range(6))


def test_merge_join():
    hit, where = C.merge(np.array([1, 3, 5, 9]), np.array([3, 4, 9]))
    assert hit.tolist() == [False, True, False, True] and where[hit].tolist() == [0, 2]
    assert C.merge(np.array([1]), np.array([], int))[0].tolist() == [False]
