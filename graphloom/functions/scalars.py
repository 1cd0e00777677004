"""Column functions over names, regions, sequences and signatures; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295
LINE = 60
NODE_BASES = 1024
OTHER, MISSING, AMBIGUOUS = "OTHER", "MISSING", "AMBIGUOUS_PARALOG"
TINY = 1e-15


def ascii_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def strict_u32(c: Column) -> Column:
    """A number of digits alone within 32 bits, else null."""
    digits = F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("bigint"))
    return F.when(digits <= U32, digits)


def region(c: Column) -> Column:
    """struct(contig, start, end), 0-based half-open, of ``contig:s-e``.

    Positions are 1-based inclusive, except that s = 0 says they are 0-based inclusive. Null if e < s or malformed.
    """
    pattern = r"^([^:]*):([0-9]{1,18})-([0-9]{1,18})$"
    s = F.regexp_extract(c, pattern, 2).try_cast("bigint")
    e = F.regexp_extract(c, pattern, 3).try_cast("bigint")
    start = F.when(s == 0, 0).otherwise(s - 1)
    end = F.when(s == 0, e + 1).otherwise(e)
    return F.when(e >= s, F.struct(F.regexp_extract(c, pattern, 1).alias("contig"), start.alias("start"), end.alias("end")))


def region_text(start: Column, end: Column) -> Column:
    """1-based inclusive text of a 0-based half-open interval."""
    return F.concat_ws("-", (start + 1).cast("string"), end.cast("string"))


def plain_contig(c: Column) -> Column:
    """What follows the last ``#``, up to an ``@``."""
    return F.substring_index(F.substring_index(c, "#", -1), "@", 1)


def without_fragment(c: Column) -> Column:
    return F.substring_index(c, "[", 1)


def contig_matches(name: Column, wanted: Column) -> Column:
    return (name == wanted) | (plain_contig(name) == wanted) | (plain_contig(name) == plain_contig(wanted))


def of_sample(name: Column, sample: Column) -> Column:
    return F.startswith(name, F.concat(sample, F.lit("#")))


#: Names of one assembly.
ALIASES = {"hg38": "grch38", "grch38": "hg38", "t2t": "chm13", "chm13": "t2t"}


def assembly_matches(sample: Column, wanted: str) -> Column:
    """Whether a sample belongs to an assembly; the empty name matches all."""
    low, want = F.lower(sample), wanted.lower()
    found = F.contains(low, F.lit(want))
    return found | F.contains(low, F.lit(ALIASES[want])) if want in ALIASES else found


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: an expression used often is not written out each time."""
    return F.get(F.transform(F.array(value), body), 0)


def three_field_name(c: Column) -> Column:
    """sample#haplotype#contig from names with one, two or more ``#``; names without are left as they are."""

    def known(x: Column) -> Column:
        return F.when(x == "", "unknown").otherwise(x)

    def named(p: Column) -> Column:
        sample, hap = known(F.get(p, 0)), F.get(p, 1)
        numbered = strict_u32(hap).isNotNull()
        joined = F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(1))), "_")
        return (
            F.when(F.size(p) == 2, F.concat_ws("#", sample, F.lit("0"), known(hap)))
            .when((F.size(p) == 3) & ~numbered, F.concat_ws("#", sample, F.lit("0"), known(F.get(p, 2))))
            .when(F.size(p) > 3, F.concat_ws("#", sample, F.when(numbered, hap).otherwise("0"), joined))
            .otherwise(F.array_join(p, "#"))
        )

    return let(F.split(c, "#", -1), named)


def name_repair(c: Column) -> Column:
    """Which repair three_field_name makes: reference, missing_haplotype, haplotype, complex or none."""
    n = F.size(F.split(c, "#", -1)) - 1
    numbered = strict_u32(F.get(F.split(c, "#", -1), 1)).isNotNull()
    return (
        F.when((n == 1) & c.rlike("^(chm13|grch38)#chr"), "reference")
        .when(n == 1, "missing_haplotype")
        .when((n == 2) & ~numbered, "haplotype")
        .when(n > 2, "complex")
        .otherwise("none")
    )


def file_safe(path_name: Column) -> Column:
    return F.translate(path_name, "#/", "__")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def oriented_slice(seq: Column, fwd: Column, start: Column, end: Column) -> Column:
    """Bases [start, end) of a node as a path sees it."""
    seen = F.when(fwd, seq).otherwise(reverse_complement(seq))
    return F.substring(seen, (start + 1).cast("int"), (end - start).cast("int"))


def wrapped(seq: Column, width: int = LINE) -> Column:
    """Lines of a fixed width, without a newline at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def chunks(seq: Column, size: int = NODE_BASES) -> Column:
    """A sequence cut into nodes; the empty sequence is one empty node."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(seq) - 1) / size), F.lit(0)).cast("int"))
    return F.transform(starts, lambda k: F.substr(seq, k * size + 1, F.lit(size)))


def anchor_offsets(length: Column, fwd: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Oriented to forward-strand offsets within a node and back: the map is its own inverse."""
    a, b = F.least(start, length), F.least(end, length)
    return F.when(fwd, a).otherwise(length - b), F.when(fwd, b).otherwise(length - a)


def oriented(node: Column, fwd: Column) -> Column:
    """(node << 1) | orientation, 1 for reverse."""
    return F.shiftleft(node, 1).bitwiseOR(F.when(fwd, 0).otherwise(1).cast("bigint"))


def step_text(node: Column, fwd: Column) -> Column:
    return F.concat(node.cast("string"), F.when(fwd, "+").otherwise("-"))


def signature(steps: Column) -> Column:
    """The lesser of a walk's text and its reverse's; steps is array<struct<node, fwd>>."""
    there = F.array_join(F.transform(steps, lambda s: step_text(s["node"], s["fwd"])), ",")
    back = F.array_join(F.transform(F.reverse(steps), lambda s: step_text(s["node"], ~s["fwd"])), ",")
    return F.least(there, back)


def signature_nodes(sig: Column) -> Column:
    """Node ids named in a signature; ``{child}`` parts and reserved labels name none."""
    parts = F.filter(F.split(sig, r"[|,]"), lambda p: p.rlike(r"^[0-9]+[+-]$"))
    return F.when(sig.isin(OTHER, MISSING, AMBIGUOUS), F.array().cast("array<bigint>")).otherwise(F.transform(parts, lambda p: F.substr(p, F.lit(1), F.length(p) - 1).cast("bigint")))


def x_ln_x(x: Column) -> Column:
    return F.when(x > TINY, x * F.log(x)).otherwise(0.0)


def unit(x: Column) -> Column:
    """Clamped to [0, 1]; null for what is not finite."""
    odd = F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))
    return F.when(~odd, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def first_largest(values: Column) -> Column:
    """0-based place of the first largest finite value, else null."""
    finite = F.transform(values, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))
    return F.when(F.array_max(finite).isNotNull(), F.array_position(finite, F.array_max(finite)) - 1)


def plain_words(text: Column) -> Column:
    """Small letters a-z only, split at white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""), r"\s+"), lambda w: w != "")


def window_of_name(name: Column) -> Column:
    """struct(start, end) of ``window_s_e`` or ``laplacian_s_e_...`` in a file name."""
    pattern = r"(?:window|laplacian)_([0-9]+)_([0-9]+)"
    s, e = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when(s != "", F.struct(s.try_cast("bigint").alias("start"), e.try_cast("bigint").alias("end")))


def intensity(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between low and high, clamped to [0, 1]; 0 where these are equal."""
    return F.when(high > low, F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2.0


def deviation_colour(value: Column, deviation: Column) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue and opacity, from 0 to 1: red above the mean and blue below, brighter up to two deviations away;
    a value of 0 is black."""
    bright = F.least(F.abs(deviation), F.lit(2.0)) / 2.0
    red = F.when((value != 0) & (deviation >= 0), bright).otherwise(0.0)
    blue = F.when((value != 0) & (deviation < 0), bright).otherwise(0.0)
    return red, F.lit(0.0), blue, F.lit(1.0)


def hsl_to_rgb(hue: Column, saturation: Column, lightness: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 255 of a hue in degrees and shares of 1."""
    chroma = (1 - F.abs(2 * lightness - 1)) * saturation
    k = F.pmod(hue, F.lit(360)) / 60.0
    x = chroma * (1 - F.abs(k - 2 * F.floor(k / 2) - 1))
    low = lightness - chroma / 2
    zero = F.lit(0.0)
    red = F.when(k < 1, chroma).when(k < 2, x).when(k < 4, zero).when(k < 5, x).otherwise(chroma)
    green = F.when(k < 1, x).when(k < 3, chroma).when(k < 4, x).otherwise(zero)
    blue = F.when(k < 2, zero).when(k < 3, x).when(k < 5, chroma).otherwise(x)
    return tuple(F.round(255 * (low + c)).cast("bigint") for c in (red, green, blue))
