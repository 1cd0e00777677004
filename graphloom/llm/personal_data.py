"""Personal data: fixed patterns, and bootstrapped contextual extraction, in Spark expressions throughout.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers with their places. Those are the
seeds: what stands around an entity makes its lexical patterns, and patterns and instances (the values found) make a
bipartite graph. Numbered strings that no fixed pattern takes are its unlabelled instances. An occurrence has up to
four patterns: the two tokens before it, the two after it, one on each side, and the one before it with the shape of
the value itself (``A`` for letters, ``9`` for each digit). Tokens are words in small letters, ``#`` for a number, ``^``
where the text begins and ``$`` where it ends; a pattern without a word is none. Contexts read to the head of the match
before and to the tail of the match after, however far that is.

Each kind of seed, with each of the four ways of reading, has a graph of its own: seeds of that kind are known in it,
seeds of other kinds are left out, unlabelled strings are in all of them. So no score mixes kinds, and the patterns that
one occurrence has do not vouch for each other.

The graph is scored by messages along its edges, each leaving out the edge it goes back on. What a pattern tells an
instance is the smoothed mean of what its *other* instances tell it; what an unlabelled instance tells a pattern is
the noisy-or of what its *other* patterns tell it, so an instance that nothing else supports counts against its
pattern; a seed always tells 1. Messages only grow and end below 1, and rounds go on until none moves by more than
``tolerance``. Patterns that end with a high mean and enough seeds then discover the unlabelled strings in them, as spans
of kind ``id``; ``found_like`` names the kind whose pattern is the surest. Edges are reduced to distinct (pattern, instance) pairs before any join, aggregates over a
pattern or an instance are combinable, and joins are plain equi-joins that Spark may split, so a context that a third
of all documents share is no single task's work.

Places are found without marking the text: the pieces that split() leaves and the matches between them, both from the
same pattern, add up to the offsets. The patterns never back up over a run they have left, so time is linear.

Cases: a null or empty text has no spans; a very long text is scanned whole; ties are ordered by kind, then start;
repeated rows are scanned row by row, and count once in the graph; null ids stay; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, written
from .quality import let

#: Possessive forms of the fixed patterns: the same leftmost matches, since a run can only end where its class ends. A
#: match starts at the head of a run, or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Unlabelled instances: capitals and digits joined by single separators.
STRING = r"(?:\G|(?<![A-Za-z0-9]))(?:[A-Z]{1,4}[\x20-]?)?+[0-9](?:[\x20./-]?[A-Z0-9])++"
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

#: A token before an entity, from its head on; and the last two of a stretch of text.
TOKEN = r"((?<!\p{L})\p{L}++|(?<!\p{N})\p{N}++)[^\p{L}\p{N}]*+"
#: A token after an entity.
AFTER = r"[^\p{L}\p{N}]*+(\p{L}++|\p{N}++)"
#: Digits beyond which the shape of a value no longer counts them.
LONG = 20
#: Pseudo-instances of score 0 in every pattern's mean, and what a pattern needs in order to discover.
SMOOTHING, CONFIDENT, SEEDS = 4.0, 0.8, 8
TOLERANCE = 1e-3
SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
CHUNK = 1024
#: The last characters of a context, which hold its two tokens as a rule; if they do not, the whole context is read.
NEAR = 64


def _scan(values: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)

    return F.aggregate(values, F.array().cast("array<int>"), step)


def running(values: Column) -> Column:
    """Running sums of an array<int>, in chunks, so that a text of very many matches stays near linear."""

    def by_chunks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        parts = F.transform(starts, lambda k: _scan(F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))

        def shifted(p: Column) -> Column:
            before = _scan(F.transform(p, lambda c: F.get(c, F.size(c) - 1)))
            return let(before, lambda b: F.flatten(F.transform(p, lambda c, i: F.transform(c, lambda x: x + F.coalesce(F.get(b, i - 1), F.lit(0))))))

        return let(parts, shifted)

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, _scan(v)).otherwise(by_chunks(v)))


def _token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\p{N}++", "#")


def context(left: Column, first: Column) -> Column:
    """The last two tokens of the text left of a match; first tells whether it reaches back to the text's beginning."""

    def tokens(x: Column) -> Column:
        last = F.regexp_extract(x, TOKEN + "$", 1)
        both = F.regexp_extract(x, TOKEN + TOKEN + "$", 1)
        head = F.when(both != "", _token(both)).when(first, F.lit("^")).otherwise(F.lit("~"))
        return F.when(last != "", F.concat_ws(" ", head, _token(last))).when(first, F.lit("^")).otherwise(F.lit("~"))

    # a character before the first token shows that the cut has not gone through it
    near = F.right(left, F.lit(NEAR))
    return F.when(near.rlike(r"(?s)(?<=.)" + TOKEN + TOKEN + "$"), tokens(near)).otherwise(tokens(left))


def context_after(right: Column, last: Column) -> Column:
    """The first two tokens of the text right of a match; last tells whether it reaches to the text's end."""

    def tokens(x: Column) -> Column:
        one = F.regexp_extract(x, "^" + AFTER, 1)
        two = F.regexp_extract(x, "^" + AFTER + AFTER, 2)
        tail = F.when(two != "", _token(two)).when(last, F.lit("$")).otherwise(F.lit("~"))
        return F.when(one != "", F.concat_ws(" ", _token(one), tail)).when(last, F.lit("$")).otherwise(F.lit("~"))

    # a character behind the second token shows that the cut has not gone through it
    near = F.left(right, F.lit(NEAR))
    return F.when(near.rlike("(?s)^" + AFTER + AFTER + "."), tokens(near)).otherwise(tokens(right))


def shape(value: Column) -> Column:
    """A for a run of letters, 9 for each digit (9+ for LONG and more), all else as it stands."""
    digits = F.regexp_replace(F.regexp_replace(value, r"\p{L}++", "A"), "[0-9]", "9")
    return F.regexp_replace(digits, f"9{{{LONG},}}", "9+")


def patterns(left: Column, right: Column, value: Column) -> Column:
    """The patterns of one occurrence, each with a letter for the way of reading it."""

    def made(t: Column) -> Column:
        before, after = t["b"], t["a"]
        ways = [("l", left), ("r", right), ("b", F.concat_ws(" _ ", before, after)), ("s", before)]
        worded = F.array(*(F.when(words.rlike(r"\p{L}"), F.concat(F.lit(way + ":"), words, *([F.lit(" _ "), shape(value)] if way == "s" else []))) for way, words in ways))
        return F.array_compact(worded)

    return let(F.struct(F.substring_index(left, " ", -1).alias("b"), F.substring_index(right, " ", 1).alias("a")), made)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left, right>> of a pattern's matches; left and right are the tokens around each,
    see context() and context_after()."""

    def placed(s: Column) -> Column:
        pieces, matches = s["p"], s["m"]
        steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        return let(
            running(steps),
            lambda at: F.transform(
                matches,
                lambda m, i: F.struct(
                    F.get(at, i).alias("start"),
                    (F.get(at, i) + F.length(m)).alias("end"),
                    m.alias("value"),
                    context(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(pieces, i)), i == 0).alias("left"),
                    context_after(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(matches, i + 1), F.lit(""))), i == F.size(matches) - 1).alias("right"),
                ),
            ),
        )

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    nothing = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)


def _is_card(value: Column) -> Column:
    def luhn(d: Column) -> Column:
        def worth(i: Column) -> Column:
            n = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> list[Column]:
    """The spans of each kind of KINDS."""
    nothing = F.array().cast(SPANS)
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(nothing)
    phone = F.when(F.contains(text, F.lit("+")), spans(text, PHONE)).otherwise(nothing)
    return [
        email,
        F.filter(spans(text, IP), lambda s: _is_ip(s["value"])),
        F.filter(spans(text, CARD), lambda s: _is_card(s["value"])),
        F.filter(phone, lambda s: _is_phone(s["value"])),
    ]


def _named(found: Column, kind: str) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row, id, the base spans of each kind, and the unlabelled strings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in zip(KINDS, base_spans(text))], spans(text, STRING).alias("strings"))

    def clear(s: Column) -> Column:
        hit = [F.exists(F.col(k), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) for k in KINDS]
        return ~reduce(lambda a, b: a | b, hit)

    return found.withColumn("strings", F.filter("strings", clear))


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, end, kind, pattern, instance) of every base span and unlabelled string, once for each pattern; kind
    is null for unlabelled strings."""

    def marked(name: str) -> Column:
        kind = F.lit(name if name != "strings" else None).cast("string").alias("kind")
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"), kind))

    out = found.select("row", F.explode(F.concat(*map(marked, (*KINDS, "strings")))).alias("s"))
    value = F.upper(F.regexp_replace("s.value", r"[^\p{L}\p{N}@]", ""))
    return out.select("row", "s.start", "s.end", "s.kind", F.explode(patterns(F.col("s.left"), F.col("s.right"), F.col("s.value"))).alias("pattern"), value.alias("instance"))


def graph_edges(seen: DataFrame) -> DataFrame:
    """(pattern, instance, seed), distinct, of occurrences: the graphs of all kinds and ways side by side, told apart by
    what their names begin with."""
    once = seen.select("kind", "pattern", "instance").distinct()
    each = once.select(F.explode(F.when(F.col("kind").isNull(), F.array(*map(F.lit, KINDS))).otherwise(F.array("kind"))).alias("of"), "pattern", "instance", F.col("kind").isNotNull().alias("seed"))
    graph = F.concat("of", F.lit(":"), F.left("pattern", F.lit(1)), F.lit(":"))
    named = each.select(F.concat("of", F.lit(":"), "pattern").alias("pattern"), F.concat(graph, "instance").alias("instance"), "seed")
    return named.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def scored_patterns(edges: DataFrame, smoothing: float = SMOOTHING, tolerance: float = TOLERANCE) -> DataFrame:
    """(pattern, confidence, seeds) of edges(pattern, instance, seed), distinct by pattern and instance.

    ``told`` is the message along an edge from its instance. An instance with one pattern that is no seed never tells
    more than 0, so only its number is kept; the edges that rounds go over are those of instances with several.
    """
    degree = edges.groupBy("instance").agg(F.count("*").alias("patterns"), F.bool_or("seed").alias("known"))
    marked = cut(edges.join(degree, "instance").select("pattern", "instance", "seed", "known", "patterns"))
    fixed = cut(marked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("known").cast("double")).alias("sure"), F.sum(F.col("seed").cast("long")).alias("seeds")))
    open_ = cut(marked.where("not known and patterns > 1").select("pattern", "instance", F.lit(0.0).alias("told")))
    while True:
        mass = fixed.join(open_.groupBy("pattern").agg(F.sum("told").alias("open")), "pattern", "left").select("pattern", "n", "seeds", (F.col("sure") + F.coalesce("open", F.lit(0.0))).alias("mass"))
        heard = open_.join(mass, "pattern").withColumn("doubt", F.log1p(-(F.col("mass") - F.col("told")) / (F.col("n") - 1 + smoothing)))
        all_doubt = heard.groupBy("instance").agg(F.sum("doubt").alias("all"))
        now = cut(heard.join(all_doubt, "instance").select("pattern", "instance", (1 - F.exp(F.col("all") - F.col("doubt"))).alias("told"), F.col("told").alias("was")))
        open_ = now.select("pattern", "instance", "told")
        if now.where(F.abs(F.col("told") - F.col("was")) > tolerance).isEmpty():
            return mass.select("pattern", (F.col("mass") / (F.col("n") + smoothing)).alias("confidence"), "seeds")


def confident_patterns(found: DataFrame, smoothing: float = SMOOTHING, tolerance: float = TOLERANCE, confident: float = CONFIDENT, seeds: int = SEEDS) -> DataFrame:
    """(pattern, confidence, like) of the patterns that may discover, after scoring the graphs; like is the kind of the
    surest graph, the first by name of equally sure ones."""
    scored = scored_patterns(graph_edges(occurrences(found)), smoothing, tolerance).where((F.col("confidence") >= confident) & (F.col("seeds") >= seeds))
    parts = F.split("pattern", ":", 2)
    best = scored.select(parts[1].alias("pattern"), F.struct((-F.col("confidence")).alias("doubt"), parts[0].alias("like")).alias("s")).groupBy("pattern").agg(F.min("s").alias("s"))
    return best.select("pattern", (-F.col("s.doubt")).alias("confidence"), "s.like")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per row of docs: id, counts of the base kinds and of ``id``, base_sha256, spans, found_like (the kinds that
    the found spans are like, in their order)."""
    found = written(scanned(docs, id_col, text_col))
    sure = cut(confident_patterns(found, **options))
    # a string may be found by several of its patterns: the surest names its kind
    hits = occurrences(found).where("kind is null").join(sure, "pattern").groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("doubt"), "like")).alias("s"))
    new = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("s.like").alias("like")))).alias("new"))
    base = F.array_join(F.array_remove(F.array(*[_named(F.col(k), k) for k in KINDS]), ""), ",")
    joined = found.join(new, "row", "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<start:int,end:int,like:string>>")))
    joined = joined.withColumns({"base": base, "extra": _named(F.col("new"), FOUND)})
    return joined.select(
        "id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size("new").cast("long").alias("n_found"),
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.array_remove(F.array("base", "extra"), ""), ",").alias("spans"),
        F.array_join(F.transform("new", lambda s: s["like"]), ",").alias("found_like"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
