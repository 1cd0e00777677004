import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import simhash as H


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\n\té İ", max_size=60))
def test_fingerprint(text):
    assert H.fingerprint(text) == slow(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert H.fingerprint(text) == slow(text) and H.fingerprint(None) == 0


def classes(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_links_keep_every_component(spark):
    import random

    rng = random.Random(5)
    prints = {0, 1, 3, 7, 15, (1 << 63) | 1, 1 << 63, (1 << 64) - 1, (1 << 64) - 4}
    for _ in range(30):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randrange(4)):
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = H.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in H.components(links).collect()}
    want = classes(prints)
    grouped = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert grouped(got) == grouped(want)


def test_components_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(4, base), (2, base + " z"), (9, base.upper()), (7, None), (5, " \n"), (8, ""), (None, base), (6, "other words here now"), (6, "other words here now")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r["id"], r["component"]) for r in H.near_components(df).collect()), key=repr)
    joined = 2 if bin(slow(base) ^ slow(base + " z")).count("1") <= 2 else 4
    assert got == sorted([(4, joined), (2, 2), (9, joined), (None, joined), (7, 5), (5, 5), (8, 5), (6, 6), (6, 6)], key=repr)
    kept = H.keep_one(df.coalesce(1))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({joined, 2, 5, 6})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_components(df).count() == 0 and H.keep_one(df).count() == 0


def test_null_and_repeated_ids_do_not_join_clusters(spark):
    texts = [" ".join(f"{t}{i}" for i in range(60)) for t in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (3, texts[4]), (8, texts[4]), (9, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(set(classes([slow(t) for t in texts]).values())) == 6
    kept = sorted(((r["doc_id"], r["text"]) for r in H.keep_one(df).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (9, texts[5])], key=repr)
    assert len({r["root"] for r in H.near_components(df).collect()}) == 6
