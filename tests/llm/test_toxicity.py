import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm import toxicity as T


def corpus(n=400):
    rng = np.random.default_rng(6)
    plain = [f"w{i}" for i in range(120)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = list(rng.choice(plain, 30)) + (list(rng.choice(["scum", "fool", "idiot"], 3)) if toxic else [])
        docs.append((i, " ".join(rng.permutation(text)), "x"))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores(spark):
    docs, labels = corpus()
    docs += [(None, "scum fool", "x"), (900, None, "x"), (901, "", "x"), (902, "idiot " * 50_000, "x"), (5, "w1", "x")]
    labels += [(None, 1), (4, None), (10, 1), (10, 0)]
    d, l = frames(spark, docs, labels)
    out = {(r["id"]): r["score"] for r in T.toxic_scores(d, l).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[902] > 0.5 and out[901] < 0.5 and out[900] == out[901]
    truth = {i: i % 5 == 0 for i in range(400) if i != 5}
    right = np.mean([(out[i] >= 0.5) == y for i, y in truth.items()])
    assert right > 0.97
    kept = T.drop_toxic(d.coalesce(1), l)
    assert kept.columns == d.columns and kept.where("doc_id = 902").count() == 0


def test_without_labels_and_empty(spark):
    docs, _ = corpus(20)
    d, l = frames(spark, docs, [])
    assert T.toxic_scores(d, l).select("score").distinct().count() == 1
    d, l = frames(spark, [], corpus(20)[1])
    assert T.toxic_scores(d, l).count() == 0


def test_nearest_is_exact(monkeypatch):
    rng = np.random.default_rng(8)
    examples = []
    for i in range(700):
        terms = sorted(rng.choice(60, rng.integers(1, 12), replace=False).tolist())
        examples.append((str(i), int(rng.random() < 0.3), terms, rng.integers(1, 5, len(terms)).tolist()))
    weight = rng.random(60) + 0.1
    index = T.Index(weight).build(examples)
    dense = np.zeros((700, 60))
    for i, _, terms, counts in examples:
        at, w = index.vector(terms, counts)
        dense[int(i), at] = w
    monkeypatch.setattr(T, "BLOCK", 16)
    index._posted()
    for trial in range(120):
        monkeypatch.setattr(T, "TAIL", (0.15, 0.6, 2.0)[trial % 3])
        if trial % 40 == 0:
            monkeypatch.setattr(T, "DENSE", (1, 8, 700)[trial // 40])
            index._posted()
        terms = sorted(rng.choice(60, rng.integers(1, 12), replace=False).tolist())
        counts = rng.integers(1, 5, len(terms)).tolist()
        at, w = index.vector(terms, counts)
        score = dense[:, at] @ w
        order = np.lexsort((np.arange(700), -np.round(score, 12)))[: T.NEAREST]
        order = order[score[order] > 0]
        hit, got = index.nearest(terms, counts)
        assert [index.ids[h] for h in hit] == [str(k) for k in order]
        assert np.allclose(got, score[order])


def test_every_word_of_the_examples_counts(spark):
    docs, labels = corpus()
    docs += [(950, "onlyhere", "x"), (952, "onlyhere", "x"), (953, "scum " + " ".join(f"rare{i}" for i in range(20)), "x"), (956, "scum", "x")]
    labels += [(i, 0) for i in (950, 953)]
    assert not any(r["held"] for r in spark.createDataFrame([(950,), (953,)], "i long").select(T.held_out(T.F.col("i")).alias("held")).collect())
    d, l = frames(spark, docs, labels)
    out = {r["id"]: r["evidence"] for r in T.toxic_scores(d, l).collect()}
    assert out[952] == "950:0:1.0000"
    # its own label is no evidence for a document
    assert "953:" not in out[953] and "950:" not in (out[950] or "")
    # the rare words are in the norm of 953, which is not a text of one word only
    assert "953:0:1.0000" not in out[956]


def brute_evidence(docs, labels):
    """(id, text) to the nearest examples, from the definitions alone."""
    toxic = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(y, toxic.get(i, 0))
    words = lambda t: Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    least = defaultdict(list)
    for i, t in docs:
        if i in toxic:
            least[i].append(t)
    examples = {i: words(min(t for t in ts if t is not None)) for i, ts in least.items() if any(t is not None for t in ts)}
    n, n1 = len(examples), sum(toxic[i] for i in examples)
    df = Counter(w for _, t in docs for w in words(t))
    of, pos = Counter(w for c in examples.values() for w in c), Counter(w for i, c in examples.items() if toxic[i] for w in c)
    weight = {}
    for w, k in of.items():
        a, b = pos[w], k - pos[w]
        c, d = n1 - a, n - n1 - b
        chi2 = n * (a * d - b * c) ** 2 / (k * (n - k) * n1 * (n - n1)) if n > k else 0.0
        if chi2 > 0:
            weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * math.sqrt(chi2)

    def vector(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    of_examples = {i: vector(c) for i, c in examples.items()}
    out = []
    for i, t in docs:
        v = vector(words(t))
        near = sorted(((-round(sum(x * e.get(w, 0) for w, x in v.items()), 12), j) for j, e in of_examples.items() if j != i))[:3]
        out.append((i, [(j, toxic[j], -s) for s, j in near if s < 0]))
    return out


def test_end_to_end_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(60)] + ["scum", "fool", "42", "7x"]
    docs = [(int(i), " ".join(rng.choice(vocab, rng.integers(1, 15)))) for i in rng.integers(0, 2**60, 150)]
    labels = [(i, int("scum" in t)) for i, t in docs[:110]]
    docs += [(docs[3][0], "w1 w2 scum"), (docs[4][0], None), (docs[5][0], docs[5][1]), (None, "scum fool"), (77, ""), (78, "unseen")]
    labels += [(docs[3][0], 1), (None, 1), (docs[8][0], None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = T.toxic_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).orderBy("row").collect()
    assert [r["id"] for r in got] == [i for i, _ in docs]
    for r, (i, near) in zip(got, brute_evidence(docs, labels)):
        found = [x.split(":") for x in r["evidence"].split(",") if x]
        assert [(int(j), int(y)) for j, y, _ in found] == [(j, y) for j, y, _ in near], i
        assert np.allclose([float(s) for *_, s in found], [s for *_, s in near], atol=6e-5)
