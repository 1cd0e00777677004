"""Quality rules: divergence of a document from its language, natively in Spark expressions.

Every text is brought to two histograms: of character classes, and of common words (the union of the lists below; a
word that is not on it counts as "other"). The reference of a language is the sum of the histograms of all its
documents that pass the base rules. A document is compared with its language's reference by the Jensen-Shannon
distance (base 2, from 0 to 1). Two guards keep short texts from being judged on noise: a histogram is compared only
from a minimum number of words on, and the divergence that so many draws from the reference itself would show on
average is taken off first. A language whose reference has too few words gives no verdict, so its documents are kept.

Cases: a null text is an empty one and fails the base rules; a null language is a language of its own; ties and
repeated rows do not matter, each row being judged alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, cut, table, words, written

#: Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it with as was on are by this be from or an not at",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un une du que qui dans est pour par sur au il ne pas plus",
    "es": "que el y los se del las por con no su para es al lo como más pero sus",
}
WORDS = tuple(sorted({w for line in COMMON.values() for w in line.split()}))
#: One printable byte for each word; a text's common words become a string of these.
CODES = "".join(chr(c) for c in range(0x23, 0x7F) if chr(c) not in "\\")[: len(WORDS)]
#: Character classes; what is left over is non-ASCII.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\x22()-]", r"[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]")
#: Documents are judged from so many words on; a reference counts from so many words of its language on.
LEAST_WORDS, LEAST_REFERENCE = 50, 2_000
#: Largest distances of a kept document.
MOST_CLASSES, MOST_WORDS = 0.2, 0.25
#: References up to this many languages (1 kB each) are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 4_096


def let(value: Column, use) -> Column:
    """use(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        in_order = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = let(in_order, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == x["x"], F.lit(False))))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = let(at, lambda s: F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))))
        some = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(some)

    return F.when(F.size(w) < 3, 0).otherwise(let(grams, covered))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _class_counts(text: Column) -> Column:
    known = [F.length(text) - F.length(F.regexp_replace(text, c + "+", "")) for c in CLASSES]
    return let(F.array(*known), lambda a: F.array_append(a, F.length(text) - F.aggregate(a, F.lit(0), lambda x, y: x + y)))


def _word_counts(w: Column) -> Column:
    code = F.create_map(*[F.lit(x) for pair in zip(WORDS, CODES) for x in pair])
    common = F.filter(F.transform(w, F.lower), lambda x: x.isin(list(WORDS)))
    coded = F.array_join(F.transform(common, lambda x: F.element_at(code, x)), "")
    counts = let(coded, lambda s: F.array(*[F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in CODES]))
    return let(counts, lambda a: F.array_append(a, F.size(w) - F.aggregate(a, F.lit(0), lambda x, y: x + y)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, lang, the base counts, base_failed and the two histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), _word_counts(w).alias("word_hist")
        ),
    )
    failed = (F.col("c.n_words") < 50) | (100 * F.col("c.n_repeat_words") > 50 * F.col("c.n_words"))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).alias("lang"),
        counted.alias("c"),
        F.length(F.regexp_replace(text, WS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
        _class_counts(text).alias("class_hist"),
    ).select("id", "lang", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", failed.alias("base_failed"), "class_hist", "c.word_hist")


def references(stats: DataFrame) -> DataFrame:
    """(lang, words, class_ref, word_ref): shares over all documents of a language that pass the base rules."""

    def sums(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(F.col(name), F.lit(k))) for k in range(n)])

    total = stats.where(~F.col("base_failed")).groupBy("lang").agg(F.sum("n_words").alias("words"), sums("class_hist", len(CLASSES) + 1).alias("c"), sums("word_hist", len(WORDS) + 1).alias("w"))
    return total.select(F.col("lang").alias("of"), "words", _shares(F.col("c")).alias("class_ref"), _shares(F.col("w")).alias("word_ref"))


def _shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def js_distance(p: Column, q: Column, draws: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, less what ``draws`` draws from q would show on average."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
    bins = F.size(F.filter(q, lambda x: x > 0))
    noise = (bins - 1) / (8 * math.log(2) * F.greatest(draws, F.lit(1)))
    return F.sqrt(F.greatest(divergence - noise, F.lit(0.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS, least_words: int = LEAST_WORDS, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """One row per row of docs: id, the base counts, base_failed, kept, class_distance and word_distance."""
    stats = written(statistics(docs, id_col, text_col, lang_col))
    ref = cut(references(stats))
    if ref.count() <= BROADCAST_LANGUAGES:
        ref = F.broadcast(ref)
    chars = F.aggregate("class_hist", F.lit(0), lambda a, b: a + b)
    judged = (F.col("n_words") >= least_words) & (F.coalesce("words", F.lit(0)) >= least_reference)
    measured = stats.join(ref, F.col("lang").eqNullSafe(F.col("of")), "left").withColumns(
        {
            "class_distance": F.when(judged, js_distance(_shares(F.col("class_hist")), F.col("class_ref"), chars)),
            "word_distance": F.when(judged, js_distance(_shares(F.col("word_hist")), F.col("word_ref"), F.col("n_words"))),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= most_classes) & (F.coalesce("word_distance", F.lit(0.0)) <= most_words)
    return measured.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _sql_distance(name: str) -> str:
    """(doc_id, v) of js_distance, from {name}_h(doc_id, bin, n) and {name}_r(lang, bin, q)."""
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
    return f"""{name}_t AS (SELECT doc_id, sum(n) AS total FROM {name}_h GROUP BY 1),
{name}_r AS (SELECT lang, bin, CASE WHEN sum(sum(n)) OVER (PARTITION BY lang) > 0 THEN sum(n) / sum(sum(n)) OVER (PARTITION BY lang) ELSE 0 END AS q FROM {name}_h JOIN b USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
{name}_p AS (SELECT doc_id, total, CASE WHEN total > 0 THEN n / total ELSE 0 END AS p, q FROM {name}_h JOIN {name}_t USING (doc_id) JOIN b USING (doc_id) JOIN {name}_r r ON r.bin = {name}_h.bin AND r.lang IS NOT DISTINCT FROM b.lang),
{name}_d AS (SELECT doc_id, sqrt(greatest(sum({part.format(x="p")} + {part.format(x="q")}) / 2 - (sum(CASE WHEN q > 0 THEN 1 ELSE 0 END) - 1) / (8 * ln(2) * greatest(max(total), 1)), 0)) AS v FROM {name}_p GROUP BY 1)"""


_LIST = ", ".join(f"'{w}'" for w in WORDS)
_CLASS_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{c}+', '', 'g'))" for c in (x.replace("'", r"\x27") for x in CLASSES))
#: The same in SQL, over long tables of words and bins.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE c > 1) GROUP BY 1),
b AS (SELECT w.doc_id, lang, CAST(len(a) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(a) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(a) AS base_failed FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
cl AS (SELECT doc_id, length(t) AS n, [{_CLASS_COUNTS}] AS k FROM d),
class_h AS (SELECT doc_id, unnest(range({len(CLASSES) + 1})) AS bin, unnest(list_append(k, n - list_sum(k))) AS n FROM cl),
wc AS (SELECT doc_id, lower(word) AS bin, count(*) AS n FROM x WHERE lower(word) IN ({_LIST}) GROUP BY 1, 2),
word_h AS (SELECT b.doc_id, v.bin, coalesce(wc.n, 0) AS n FROM b, (SELECT unnest([{_LIST}]) AS bin) v LEFT JOIN wc ON wc.doc_id = b.doc_id AND wc.bin = v.bin
  UNION ALL SELECT b.doc_id, '', n_words - coalesce((SELECT sum(n) FROM wc WHERE wc.doc_id = b.doc_id), 0) FROM b),
{_sql_distance("class")}, {_sql_distance("word")},
lw AS (SELECT lang, sum(n_words) AS words FROM b WHERE NOT base_failed GROUP BY 1),
j AS (SELECT b.*, CASE WHEN n_words >= {LEAST_WORDS} AND coalesce(words, 0) >= {LEAST_REFERENCE} THEN class_d.v END AS cv, CASE WHEN n_words >= {LEAST_WORDS} AND coalesce(words, 0) >= {LEAST_REFERENCE} THEN word_d.v END AS wv
  FROM b LEFT JOIN lw ON lw.lang IS NOT DISTINCT FROM b.lang LEFT JOIN class_d ON class_d.doc_id = b.doc_id LEFT JOIN word_d ON word_d.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cv, 0) <= {MOST_CLASSES} AND coalesce(wv, 0) <= {MOST_WORDS} AS kept,
  round(cv, 6) AS class_distance, round(wv, 6) AS word_distance FROM j
"""
