"""Column builders of the token model: words, slugs, n-grams, token sets, Jaccard, predicates on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a claim as factual (recalled texts: RECALL_WORDS too), regexes of refused secrets, size limit (fixed values).
FACT_WORDS = ("$", "balance", "wallet", "ledger")
RECALL_WORDS = ("total",)
SECRETS = (r"ghp_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"sk-[A-Za-z0-9]{20,}", r"AKIA[0-9A-Z]{16}", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----")
MAX_CONTENT = 8192


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 2)


def word_set(c: Column) -> Column:
    """Distinct lower-case words between blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))


def slug(c: Column) -> Column:
    """The first six words, joined by underscores."""
    return F.array_join(F.slice(words(c), 1, 6), "_")


def ngrams(ws: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words, joined by underscores."""
    k = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    out = F.slice(ws, 1, k)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(ws, i + 1, k), lambda a, b: F.concat_ws("_", a, b))
    return out


def _prefixed(p: str, ws: Column) -> Column:
    return F.transform(ws, lambda w: F.concat(F.lit(p), w))


def rich_tokens(content: Column, context: Column, outcome: Column) -> Column:
    """Distinct tokens of a row: words by field, word pairs and triples of the content, context and summary slugs."""
    w = words(content)
    return F.array_distinct(
        F.concat(
            _prefixed("c:", w), _prefixed("x:", words(context)), _prefixed("o:", words(outcome)), _prefixed("bg:c:", ngrams(w, 2)), _prefixed("tg:c:", ngrams(w, 3)),
            F.array(F.concat(F.lit("ctx@"), slug(context)), F.concat(F.lit("sum@"), slug(F.substring(F.coalesce(content, F.lit("")), 1, 48)))),
        )
    )


def cue_tokens(cue: Column) -> Column:
    """Tokens of a cue: those of a row with that content and nothing else."""
    return rich_tokens(cue, F.lit(""), F.lit(None).cast("string"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; zero if either is empty."""
    u = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of equal length, in double; zero if a norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms <= 1e-8), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def is_factual(content: Column, more: tuple = ()) -> Column:
    """The text states something that could be checked: money words (or ``more``) or a digit."""
    low = F.lower(content)
    out = low.rlike("[0-9]")
    for w in (*FACT_WORDS, *more):
        out = out | low.contains(w)
    return out


def dollar_amounts(c: Column) -> Column:
    """All amounts of the form $12.34, as doubles."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\$\s*(\d+(?:\.\d{1,2})?)"), 1), lambda x: x.cast("double"))


def has_secret(c: Column) -> Column:
    out = F.lit(False)
    for s in SECRETS:
        out = out | c.rlike(s)
    return out


def micro(c: Column) -> Column:
    """A number in millionths, rounded half up: equal in every engine."""
    return F.floor(c * 1_000_000 + 0.5).cast("long")
