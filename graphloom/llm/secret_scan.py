"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from text spends few tokens on words and many on random strings. So a string of 12
characters or more (ASCII letters, digits and ``+/_=-``, not inside a longer word) whose characters per token, under
the public tiktoken vocabulary, are few is reported as ``random``; strings under 20 characters and those of letters
alone need fewer still. Strings that are known digests (hexadecimal of a digest's length) or identifiers (UUIDs, numbers, numbered names, dates) are
excluded first, and so are strings that a fixed pattern has found already.

Cases: a null text is an empty one and has no spans; a text of any length is scanned whole, in time linear in its
length; ties (spans of one start) are ordered by kind; repeated rows and null ids are scanned row by row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import fast_encoder

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
#: The fixed patterns; (?a) keeps case folding to ASCII.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Strings of 12 characters or more, as in ``assign``, are put to the test: to the last place that no letter, digit or
#: underscore of any script follows.
CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{12,}(?!\w)")
LETTERS = re.compile(r"[A-Za-z]+")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Numbers and dates, or words (small, capitalized or in capitals) with a number at the end, joined by separators. No
#: two alternatives can match at one place and no run is given back, so the time is linear.
_WORD = r"[A-Z]{2,}+|[A-Z][a-z]*+|[a-z]++"
IDENTIFIER = re.compile(rf"[0-9+/_=-]++|(?:{_WORD})?+(?:[+/_=-]++(?:{_WORD}|[0-9]++))*+[0-9]{{0,4}}")
#: Characters per token at most: prose has about 4, invented words 2.5, random letters and digits 1.5.
MOST_PER_TOKEN = 2.0
#: Strings under LONG characters and those of letters alone must have fewer, in relation to the others: 1.6 for 2.0.
LONG, STRICT = 20, 0.8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # runs are maximal, so asking for 16 characters drops the short runs and changes no other
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_known(string: str) -> bool:
    """A digest or an identifier."""
    if len(string) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", string):
        return True
    return bool(UUID.fullmatch(string) or IDENTIFIER.fullmatch(string))


def random_spans(text: str, taken: list[tuple[int, int, str]], most: float = MOST_PER_TOKEN, folder: str | None = None) -> list[tuple[int, int, str]]:
    """Strings with letters of few characters per token, clear of the spans taken."""
    found, taken = [], sorted(taken)
    ends = list(accumulate((b for _, b, _ in taken), max))
    for m in CANDIDATE.finditer(text):
        s = m[0]
        letters = bool(LETTERS.fullmatch(s))
        # a run of letters is no identifier by its form: the test tells words from random letters
        if not re.search("[A-Za-z]", s) or not letters and is_known(s):
            continue
        before = bisect_left(taken, (m.end(),))
        if before and ends[before - 1] > m.start():
            continue
        limit = most * STRICT if letters or len(s) < LONG else most
        if len(s) <= limit * len(fast_encoder(folder).encode_ordinary(s)):
            found.append((m.start(), m.end(), "random"))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scanning(most: float, folder: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                text = text or ""
                base = base_spans(text)
                extra = random_spans(text, base, most, folder)
                n = [sum(k == kind for *_, k in base) for kind in BASE]
                rows.append((*n, len(extra), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + extra)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            out.insert(0, "id", pdf["id"])
            yield out

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_PER_TOKEN, folder: str | None = None) -> DataFrame:
    """One row per row of docs: id, counts by kind, base_sha256 and spans (kind:start:end, code points, end exclusive)."""
    schema = "id string, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    # as text: pandas would turn whole numbers beside a null into doubles
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(_scanning(most, folder), schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
