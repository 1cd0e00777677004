import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import quality as Q

WORDS = "the of and to in is that it for was on are".split()


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_and_verdicts(spark):
    rng = np.random.default_rng(1)
    prose = [" ".join(rng.choice([*WORDS, "stone", "river", "cloud", "branch"], 120)) + "." for _ in range(60)]
    junk = ["%%% ### " * 100, "ALL CAPS WORDS " + "SHOUT LOUD NOW GO " * 3 + " ".join(f"X{i}Y" for i in range(120))]
    odd = [None, "", " \n\t", "a b c a b c", "x", "a a a a a", "line\nline\n \n \nline", "é ü ß | <b>", "w " * 30_000, "\x0b\x0c\r"]
    texts = prose + junk + odd + prose[:2]
    df = spark.createDataFrame([(i if i % 9 else None, t, "en" if i % 4 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    out = Q.judge(df.withColumn("doc_id", F.monotonically_increasing_id()).coalesce(1)).collect()
    got = Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == Counter(base(t) for t in texts)
    kept = [r for r in out if r["kept"]]
    assert not any(r["base_failed"] for r in kept) and len(kept) >= 60


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    want = math.sqrt((kl(p) + kl(q)) / 2)
    c = lambda x: F.array(*[F.lit(v) for v in x])
    got = spark.range(1).select(Q.js_distance(c(p), c(q), F.lit(10**9)).alias("d"), Q.js_distance(c(p), c(p), F.lit(10)).alias("z")).first()
    assert math.isclose(got["d"], want, rel_tol=1e-6) and got["z"] == 0.0


def test_empty(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
