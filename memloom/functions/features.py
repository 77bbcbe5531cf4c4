"""Hashed features of rows and cues: granules, pair bindings, signed projections, and the model's small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions import stages as S

DIGITS = 15


def feature(*parts: Column) -> Column:
    """A 60-bit feature of its parts: the first 15 hexadecimal digits of an md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("long")


def granules(tokens: Column, life: Column) -> Column:
    """Sorted distinct features of a token list, two of each token (the halves of one hash), of one life."""
    half = lambda h, k: F.conv(F.substring(h, k, DIGITS), 16, 10).cast("long")
    hashed = F.transform(tokens, lambda t: F.md5(F.concat_ws("|", life, t)))
    return F.sort_array(F.array_distinct(F.concat(F.transform(hashed, lambda h: half(h, 1)), F.transform(hashed, lambda h: half(h, 1 + DIGITS)))))


def neighbours(xs: Column) -> tuple[Column, Column]:
    """Two arrays of equal length: all elements but the last, and all but the first."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.slice(xs, 1, n), F.slice(xs, 2, n)


def bound(dg: Column, extra: Column | None = None) -> Column:
    """Granules with a feature for each neighbouring pair (and for the pair ``extra``), sorted and distinct."""
    a, b = neighbours(dg)
    pairs = F.zip_with(a, b, lambda x, y: feature(x.cast("string"), y.cast("string")))
    both = F.concat(dg, pairs) if extra is None else F.concat(dg, pairs, F.coalesce(F.transform(F.slice(extra, 1, 1), lambda x: feature(x.cast("string"), F.get(extra, 1).cast("string"))), F.array().cast("array<bigint>")))
    return F.sort_array(F.array_distinct(both))


def band_sums(vec: Column, key: Column, bands: int = 16) -> Column:
    """``bands`` signed sums of a vector of at most 64 numbers; the signs come from a hash of ``key`` and the band."""
    def one(b: Column) -> Column:
        bits = F.concat(F.md5(F.concat_ws("|", key, b.cast("string"), F.lit("a"))), F.md5(F.concat_ws("|", key, b.cast("string"), F.lit("b"))))
        signed = F.transform(vec, lambda x, i: F.when(bits.substr(i + 1, F.lit(1)) < "8", x.cast("double")).otherwise(-x.cast("double")))
        return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), one)


def band_features(sums: Column) -> Column:
    """A feature for each band and its sum to four digits."""
    return F.transform(sums, lambda x, i: feature(F.lit("band"), i.cast("string"), F.floor(x * 10_000 + 0.5).cast("string")))


def shared(cue: Column, *sets: Column) -> Column:
    """Largest share of the cue's features found in one of ``sets``; zero for a cue without features."""
    hits = [F.size(F.array_intersect(cue, s)) for s in sets]
    return F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(0)) / F.greatest(F.size(cue), F.lit(1))


def jaccard_merge(a: Column, b: Column) -> Column:
    """Jaccard of the merge rule: two empty sets are equal."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def cosine_shorter(a: Column, b: Column) -> Column:
    """Cosine over the length of the shorter vector, norms included; zero if a squared norm is next to nothing."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    xx, yy = dot(x, x), dot(y, y)
    return F.when((n <= 0) | (xx <= 1e-8) | (yy <= 1e-8), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / F.sqrt(xx) / F.sqrt(yy))))


def plasticity(dopamine: Column, acetylcholine: Column, norepinephrine: Column, salience: Column) -> Column:
    """How much a row may change weights: modulators and salience, within 0.05 and 1."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.4 * dopamine + 0.3 * acetylcholine + 0.3 * norepinephrine + 0.5 * salience))


def blended(vectors: Column, weights: Column) -> Column:
    """Running mean of a list of equally long vectors: the first as it is, each later one with a fifth of its weight, within 0.01 and 0.35."""
    alpha = lambda w: F.greatest(F.lit(0.01), F.least(F.lit(0.35), w.cast("double") * 0.2))
    both = F.zip_with(vectors, weights, lambda v, w: F.struct(F.transform(v, lambda x: x.cast("double")).alias("v"), alpha(w).alias("a")))
    first = F.get(both, 0)["v"]
    return F.aggregate(F.slice(both, 2, F.greatest(F.size(both) - 1, F.lit(0))), first, lambda acc, y: F.zip_with(acc, y["v"], lambda p, q: p * (1 - y["a"]) + q * y["a"]))


def stage_of(value: Column, field: int) -> Column:
    """A column of the stage table by stage number."""
    out = F.lit(S.STAGES[0][field])
    for row in S.STAGES[1:]:
        out = F.when(value == row[0], F.lit(row[field])).otherwise(out)
    return out
