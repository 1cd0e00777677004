"""The order of visits by their past, its runs, and search, against sorting and counting in memory."""

import itertools
import random

import pytest

from graphloom.operators import haplotypes as H


def walks_of(seed, n, longest, nodes, copies=True):
    rng = random.Random(seed)
    walks = [[rng.randrange(nodes) for _ in range(rng.randrange(1, longest))] for _ in range(n)]
    if copies:  # haplotypes are mostly alike
        walks += [list(w) for w in walks[: n // 2]] + [w[: len(w) // 2] for w in walks[: n // 3]] + [[7] * longest, [7] * (longest - 1)]
    return dict(enumerate(walks))


def frame(spark, walks):
    return spark.createDataFrame([(w, k, n) for w, nodes in walks.items() for k, n in enumerate(nodes)], "walk long, step long, node long").repartition(3)


def in_order(walks):
    visits = [(w, k, n) for w, nodes in walks.items() for k, n in enumerate(nodes)]
    return sorted(visits, key=lambda v: (walks[v[0]][v[1] :: -1] if v[1] else walks[v[0]][:1], v[0]))


CASES = [walks_of(1, 12, 20, 5), walks_of(2, 5, 60, 2), walks_of(3, 30, 4, 50, False), {0: [3]}, {0: [1, 1, 1, 1], 1: [1, 1]}]


@pytest.mark.parametrize("walks", CASES, ids=range(len(CASES)))
def test_order_and_runs(spark, walks):
    order = H.ordered(frame(spark, walks))
    want = in_order(walks)
    assert [tuple(r)[:3] for r in order.orderBy("pos").collect()] == want
    assert [r["pos"] for r in order.orderBy("pos").collect()] == list(range(len(want)))
    place = {(w, k): p for p, (w, k, _) in enumerate(want)}
    after = [(n, walks[w][k + 1] if k + 1 < len(walks[w]) else None, place.get((w, k + 1))) for w, k, n in want]
    runs, at = [], 0
    for key, group in itertools.groupby(after, key=lambda x: x[:2]):
        group = list(group)
        runs.append((*key, at, len(group), group[0][2]))
        at += len(group)
    for size in (4, 1 << 16):
        got = H.runs(order, size).select("node", "next", "start", "length", "to").orderBy("start").collect()
        assert [tuple(r) for r in got] == runs
    for node, nxt, start, length, to in runs:  # places of a run go over to consecutive places
        assert nxt is None or [after[p][2] for p in range(start, start + length)] == list(range(to, to + length))


@pytest.mark.parametrize("walks", CASES[:2] + CASES[3:], ids=range(4))
def test_search(spark, walks):
    rng = random.Random(9)
    patterns = {}
    for p in range(40):
        nodes = walks[rng.choice(list(walks))]
        a = rng.randrange(len(nodes))
        patterns[p] = nodes[a : a + rng.randrange(1, 6)] + ([rng.randrange(5)] if rng.random() < 0.3 else [])
    patterns[99] = [12345]
    order = H.ordered(frame(spark, walks))
    asked = spark.createDataFrame([(p, k, n) for p, nodes in patterns.items() for k, n in enumerate(nodes)], "pattern long, at long, node long")
    got = {r["pattern"]: (r["hits"], r["walks"]) for r in H.walks_with(order, H.runs(order), asked, bucket=3).collect()}
    want = {}
    for p, nodes in patterns.items():
        hits = [(w, k) for w, steps in walks.items() for k in range(len(steps)) if steps[k : k + len(nodes)] == nodes]
        if hits:
            want[p] = (len(hits), len({w for w, _ in hits}))
    assert got == want


def test_nothing(spark):
    order = H.ordered(frame(spark, {0: [1]}).where("step < 0"))
    assert order.count() == 0 and H.runs(order).count() == 0


def test_ranks_of_several_steps_in_one_number(spark, monkeypatch):
    """Rounds follow the length of walks by more than doubling, and the order is the same where walks are cut into blocks."""
    rounds, rank = [], H.with_rank
    monkeypatch.setattr(H, "with_rank", lambda df, *keys, **kw: rounds.append(kw["name"]) or rank(df, *keys, **kw))
    walk = [k * k % 7 % 3 for k in range(40)]
    steps = frame(spark, {0: walk, 1: walk, 2: walk[5:]})
    want = [tuple(r) for r in H.ordered(steps).orderBy("pos").collect()]
    assert rounds.count("finer") <= 3  # by doubling there were seven
    assert [tuple(r) for r in H.ordered(steps, size=31).orderBy("pos").collect()] == want
    assert [(w, s) for w, s, *_ in want] == sorted(((w, s) for w, n in ((0, 40), (1, 40), (2, 35)) for s in range(n)), key=lambda v: ((walk[5:] if v[0] == 2 else walk)[v[1] :: -1], v[0]))


def test_search_sends_no_growing_side(spark):
    """What a search keeps is small in files and not in memory: its joins are by exchange whatever the files' size."""
    order = H.ordered(frame(spark, {0: [1, 2, 3], 1: [1, 2, 4]}))
    asked = spark.createDataFrame([("p", 0, 1), ("p", 1, 2)], "pattern string, at long, node long")
    plan = H.walks_with(order, H.runs(order), asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [bucket" in plan
