"""Keyword-stuffed pages, link lists and product tags among the documents of a crawl.

One pass measures every text: share of the most frequent word pair and of the
ten most frequent ones, share of words inside links, separators per word,
share of repeated lines and share of function words.  The thresholds follow
the language: medians over all documents of the language set what is usual,
and a page is reported where it is far from that.  (The medians leave out texts
under twelve words, which have no ten pairs; those texts are judged like all.)
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import materialize, spread

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of to and in is was were are be been that which who it its for on with as by at from this these those but or not no we our they their them i you he she has have had will would can could should may must do does did so if when while than then there what how why after before into over under about between through during until only some any all more most other also because although nobody",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine ist war waren sind wird werden wurde hat haben hatte ich du er sie es wir ihr sich mit von zu zum zur im in am an auf aus bei nach vor über unter für um durch bis dass ob weil wenn als wie obwohl nur noch auch sehr so eines man",
    "es": "el la los las lo un una unos unas de del al y o pero no sin con por para en sobre entre según es era son fue ser está estaba han ha había que quien como cuando donde si porque aunque más menos muy ya se su sus nos me te le les desde hasta tras esta este eso",
    "fr": "le la les l un une des du de d au aux et ou mais ne pas sans avec par pour dans sur sous entre est était sont fut être a ont avait que qui quoi dont où quand si parce bien plus moins très se s son sa ses nous vous il elle ils elles on ce cette ces y en après avant depuis jusqu donc",
    "zh": "的 了 在 是 不 和 与 及 或 但 而 也 就 都 又 被 把 从 到 对 为 因 所 以 之 后 前 仍 我 们 你 他 她 它 这 那 有 没 一 个 着 过",
}
SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
LANGUAGES = tuple(FUNCTION_WORDS)

URL = re.compile(r"(?:https?:)?//[^\s\"'<>)\]]+|\bwww\.[^\s\"'<>)\]]+|\b(?:[a-z0-9-]+\.)+(?:com|net|org|info|biz|shop|io|example|test|invalid)\b(?:/[^\s\"'<>)\]]*)?", re.I)
ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
MARKDOWN = re.compile(r"\[([^\[\]\n]+)\]\(([^()\s]*)\)")
TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[⺀-鿿]|[^\W_⺀-鿿]+")
SEPARATOR = re.compile(r"[|,;#•·»›>*=，、；/\n]| - ")
HASHTAG = re.compile(r"#\w+")

COLUMNS = ("guess", "n_words", "top_word", "top_pair", "ten_pairs", "link_share", "separators", "repeated_lines", "function_share", "rest_share", "rest_function_share", "repeats", "evidence")
SCHEMA = "guess string, n_words long, top_word double, top_pair double, ten_pairs double, link_share double, separators double, repeated_lines double, function_share double, rest_share double, rest_function_share double, repeats long, evidence long"


NOTHING = (None, 0, *[0.0] * 9, 0, 0)
SENTENCE_END = re.compile(r"[.!?。！？:][\"'”’)\]]*$")


def _is_prose(line: list[str], text: str, known: frozenset) -> bool:
    """A line of at least five words that ends as a sentence and has its share of function words."""
    return len(line) >= 5 and bool(SENTENCE_END.search(text)) and sum(w in known for w in line) >= 0.2 * len(line) and len(set(line)) >= 0.6 * len(line)


def measures(text: str | None) -> tuple:
    """The measures of one text; a null or wordless text has zero words and zero everywhere."""
    if not text:
        return NOTHING
    linked = links = 0

    def anchor(m: re.Match) -> str:
        nonlocal linked, links
        links += 1
        linked += len(WORD.findall(TAG.sub(" ", m[1])))
        return f" {m[1]} "

    body = MARKDOWN.sub(lambda m: anchor(m) + " " + m[2], ANCHOR.sub(anchor, text))
    plain = TAG.sub(" ", body)
    urls = URL.findall(plain)
    linked += sum(len(WORD.findall(u.replace("_", " "))) for u in urls)
    lower = plain.replace("_", " ").lower()
    words = WORD.findall(lower)
    n = len(words)
    if not n:
        return NOTHING
    bare = WORD.findall(URL.sub(" ", lower)) if urls else words
    counts = Counter(bare)
    known = {k: sum(c for w, c in counts.items() if w in s) for k, s in SETS.items()}
    cjk = sum(c for w, c in counts.items() if "⺀" <= w <= "鿿")
    guess = "zh" if cjk > 0.4 * max(1, len(bare)) else max((k for k in SETS if k != "zh"), key=lambda k: known[k])
    if guess != "zh" and known[guess] < 0.08 * max(1, len(bare)):
        guess = None
    share = max(known.values()) / n
    pairs = Counter(p for p in zip(words, words[1:]) if not (p[0].isdigit() and p[1].isdigit()))
    total = max(1, n - 1)
    best = pairs.most_common(10)
    lines = [x.strip() for x in lower.split("\n") if x.strip()]
    rest: list[str] = []
    prose_set = frozenset().union(*SETS.values())
    for x in lines:
        ws = WORD.findall(x)
        if not _is_prose(ws, x, prose_set):
            rest += ws
    mine = SETS[guess] if guess else prose_set
    rest_share = sum(w in mine for w in rest) / max(1, len(rest))
    marks = len(SEPARATOR.findall(plain)) + len(HASHTAG.findall(plain))
    return (
        guess, n, max(counts.values(), default=0) / n, best[0][1] / total if best else 0.0, sum(c for _, c in best) / total, min(1.0, linked / n),
        marks / n, 1 - len(set(lines)) / max(1, len(lines)), share, len(rest) / n, rest_share, best[0][1] if best else 0, marks + links + len(urls) + len(bare) - len(counts),
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one column per measure and ``language``."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCHEMA.split(', '))}>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(t) for t in s], columns=list(COLUMNS)).astype({"n_words": "int64", "repeats": "int64", "evidence": "int64"})

    out = spread(docs).withColumn("_m", run(F.col(text))).select(*[c for c in docs.columns if c not in COLUMNS], "_m.*")
    said = F.lower(F.substring(F.trim(F.col("lang")), 1, 2)) if "lang" in docs.columns else F.lit(None).cast("string")
    return out.withColumn("language", F.coalesce("guess", F.when(said.isin(*LANGUAGES), said), F.lit("en")))


def calibrated(measured: DataFrame, prior: int = 30) -> DataFrame:
    """Medians of the measures by language over all documents, drawn towards those of all languages with the weight of ``prior`` documents."""
    cols = ("function_share", "top_pair", "ten_pairs", "separators")
    med = lambda c: F.percentile_approx(c, 0.5, 1000)
    m = measured.filter("n_words >= 12")
    alls = m.agg(*[med(c).alias(f"all_{c}") for c in cols])
    by = measured.groupBy("language").agg(F.count_if(F.col("n_words") >= 12).alias("n"), *[med(F.when(F.col("n_words") >= 12, F.col(c))).alias(f"med_{c}") for c in cols])
    # at most one row per language of LANGUAGES; without any page of some length the medians are zero
    mixed = lambda c: (F.col("n") * F.coalesce(f"med_{c}", F.lit(0.0)) + prior * F.coalesce(f"all_{c}", F.lit(0.0))) / (F.col("n") + prior)
    return by.crossJoin(F.broadcast(alls)).select("language", *[mixed(c).alias(f"med_{c}") for c in cols])


REPEATS = 3


def reason() -> Column:
    """Why a measured page with its language's medians is spam; null if it is none.

    A list shows in at least REPEATS separators, links or repeated words, a
    stuffed page in a pair of words that stands REPEATS times; there is no
    other limit on length.
    """
    c = F.col
    few = (c("rest_function_share") < 0.22 * c("med_function_share")) & (c("rest_share") >= 0.5) & (c("evidence") >= REPEATS)
    stuffed = (c("top_pair") >= F.greatest(F.lit(0.10), 4 * c("med_top_pair"))) & (c("ten_pairs") >= F.greatest(F.lit(0.30), 1.8 * c("med_ten_pairs"))) & (c("repeats") >= REPEATS)
    listy = (c("separators") >= F.greatest(F.lit(0.15), 1.2 * c("med_separators"))) | (c("ten_pairs") >= 0.15) | (c("top_word") >= 0.08) | (c("repeated_lines") >= 0.2)
    return F.when((c("link_share") >= 0.3) & few, "links").when(few & listy, "tags").when(stuffed, "stuffed")


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its measures, language and ``reason`` (null: no spam).

    Documents without words have no reason.  Repeated rows are judged alike.
    """
    keep = [id_col, *(x for x in ("lang",) if x in docs.columns)]
    m = materialize(with_measures(docs.select(*keep, text), text).drop(text, "lang"), "measures")
    return m.join(F.broadcast(calibrated(m)), "language", "left").withColumn("reason", reason()).select(id_col, "language", *COLUMNS[1:], "reason")
