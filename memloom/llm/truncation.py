"""Texts cut off before their end, by storage limits or in mid-transfer.

First the lengths: every text is measured in code points, in UTF-8 bytes,
with entities or JSON escapes, with CRLF line ends and so on.  A source whose
texts pile up at one length of one measure, and hardly ever exceed it, has a
hidden limit there.  Then the endings: over all texts it is counted how often
each short ending context (last words, or last CJK characters) stands at the
end of a sentence or text, and how often inside one.  A text at a limit of its
source is cut unless its ending is a usual one; any other text is cut only if
its ending hardly ever ends anything, or breaks off inside a word.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memloom.llm.textnorm import plain
from memloom.sources.tables import materialize, spread

#: Measures of length (fixed order: of equal evidence the first one names the limit).
MEASURES = ("chars", "utf8", "utf16", "entities", "entities_utf8", "json", "json_ascii", "json_utf8", "crlf", "crlf_utf8")

#: Marks that say a text was cut, and dots that may say so or be the text's own (fixed values).
SPOKEN_MARK = re.compile(r"\s*(?:[\[(<]\s*(?:truncated|cut(?: off)?|snip(?:ped)?|more|continued|abridged|gekürzt|tronqué|truncado)\s*[\])>]|\[(?:\.\.\.|…)\])\s*(?:</\w+>\s*)?$", re.I)
DOTS = re.compile(r"\s*(?:…|\.{2,})\s*$")
CLOSERS = "\"'”’»)]}>`*_"
FINAL = ".!?。！？"
NEVER_LAST = ",;:，、；：—–-(/&+=#@[{"
TOKEN = re.compile(r"[⺀-鿿]|[^\W_⺀-鿿]+(?:['’][^\W\d_]+)*|[^\w\s]")


def lengths(t: str) -> tuple[int, ...]:
    n = len(t)
    if t.isascii():
        b = u16 = n
        ju = ja = len(json.dumps(t)) - 2
    else:
        b = len(t.encode("utf-8", "surrogatepass"))
        u16 = n + sum(c > "\uffff" for c in t)
        ja, ju = len(json.dumps(t)) - 2, len(json.dumps(t, ensure_ascii=False)) - 2
    special = "&" in t or "<" in t or ">" in t or '"' in t or "'" in t
    extra = len(html.escape(t)) - n if special else 0
    nl = t.count("\n") - t.count("\r\n")
    return n, b, u16, n + extra, b + extra, ju, ja, b + ju - n, n + nl, b + nl


L = "[^\\W_⺀-鿿]"
NUMBER = re.compile(f"(?:{L}+[-:#./]|#)*(?={L}*\\d){L}+(?:[-.:/](?={L}*\\d){L}+)*")


def folded(t: str) -> list[str]:
    """Tokens of a plain text; a number or identifier with what hangs on it is the token ``0``."""
    return TOKEN.findall(NUMBER.sub("0", t))


def before(tk: list[str], i: int) -> str:
    """The context of token i: the token before, or up to three if a number is among them."""
    if i == 0:
        return "^"
    if tk[i] == "0" or tk[i - 1] == "0":
        return " ".join(tk[max(0, i - 3) : i]) if i >= 3 else "^ " + " ".join(tk[:i])
    return tk[i - 1]


def ending(text: str, body: str) -> tuple[str, str, bool, bool]:
    """(word before, last word, cut for certain, ends properly) of a text; ``body`` is its plain form."""
    if SPOKEN_MARK.search(text[-40:]) or text.rstrip()[-1:] == "\ufffd":
        return "", "", True, False
    b = body.rstrip()
    if b[:1] == "{" and '"' in b[:3]:
        return "", "", not b.endswith("}"), b.endswith("}")
    bare = DOTS.sub("", b)
    dotted = len(bare) < len(b)
    core = bare.rstrip(CLOSERS + " \t\n")
    if not core:
        return "", "", False, True
    if not dotted and core[-1] in FINAL:
        return "", "", False, True
    if core[-1] in NEVER_LAST and len(core) == len(bare):
        return "", "", True, False
    line = bare.rsplit("\n", 1)[-1]
    if line.count("(") > line.count(")") or bare.count('"') % 2 and '"' in line:
        return "", "", True, False
    tk = folded(core)
    if not tk:
        return "", "", False, True
    closed = len(core) < len(bare) and not dotted
    return before(tk, len(tk) - 1), tk[-1], False, closed


def sites(body: str) -> list[tuple[str, str, bool]]:
    """(word before, word, ends) for each word: does a sentence, line or the text end after it?"""
    out = []
    for line in body.split("\n"):
        tk = folded(line)
        while tk and tk[-1] in CLOSERS:
            tk.pop()
        last = len(tk) - 1
        for i, w in enumerate(tk):
            if w[0].isalnum():
                out.append((before(tk, i), w, i == last or tk[i + 1] in FINAL))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of two sorts: one per record with its measures and ending, and partial counts of the word pairs of a batch."""
    for pdf in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        recs = []
        for kind, key, feed, t in zip(pdf["rec_kind"], pdf["rec_key"], pdf["feed"], pdf["text"]):
            if not t or not t.strip():
                continue
            body = plain(t)
            recs.append((kind, key, feed, *ending(t, body), list(lengths(t))))
            for a, b, e in sites(body):
                c = counts.setdefault((a, b), [0, 0])
                c[0] += 1
                c[1] += e
        if recs:
            r = pd.DataFrame(recs, columns=["rec_kind", "rec_key", "feed", "prev", "last", "certain", "proper", "lens"])
            r["n"] = r["n_end"] = 0
            yield r[COLUMNS]
        if counts:
            k = list(counts)
            c = pd.DataFrame({"rec_kind": None, "rec_key": None, "feed": None, "prev": [x[0] for x in k], "last": [x[1] for x in k], "certain": False, "proper": False, "lens": None, "n": [counts[x][0] for x in k], "n_end": [counts[x][1] for x in k]})
            yield c[COLUMNS]


HEAD = 8


def _longer(known: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """(by, last, n): how often words stand that begin with ``last`` and are longer.

    Words meet ends on at most HEAD of their first letters, so a word gives no
    more than HEAD rows however long it is; the rest of a longer end is compared.
    """
    head = known.select(*by, F.col("last").alias("word"), "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("last")))).alias("_k")).withColumn("_h", F.expr("substring(word, 1, _k)"))
    e = ends.select(*by, "last", F.substring("last", 1, HEAD).alias("_h"))
    met = head.join(e, [*by, "_h"]).filter((F.length("word") > F.length("last")) & F.col("word").startswith(F.col("last")))
    return met.groupBy(*by, "last").agg(F.sum("n").alias("n"))


COLUMNS = ["rec_kind", "rec_key", "feed", "prev", "last", "certain", "proper", "lens", "n", "n_end"]
USUAL = 0.4


def cut_records(rows: DataFrame) -> DataFrame:
    """Every record of ``rows`` (rec_kind, rec_key, feed, text) with how it ends.

    Adds certain (marked or unclosed), proper (ends as a text should),
    end_share (how often its last words end something), limit_measure (of a
    hidden limit of its feed at which it stands, else null) and ``cut``.
    Null and blank texts are no records; repeated rows are judged alike.
    """
    schema = "rec_kind string, rec_key string, feed string, prev string, last string, certain boolean, proper boolean, lens array<int>, n long, n_end long"
    scan = materialize(spread(rows.select("rec_kind", "rec_key", "feed", "text")).mapInPandas(_scan, schema), "scan")
    recs = scan.filter("rec_kind is not null").drop("n", "n_end")
    pairs = materialize(scan.filter("rec_kind is null").groupBy("prev", "last").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "pairs")
    words = pairs.groupBy("last").agg(F.sum("n").alias("n1"), F.sum("n_end").alias("e1"))
    open_ends = recs.filter("not certain and not proper").select("prev", "last").distinct()
    # how often a longer word stands where this one would: (word before, proper beginning of the word)
    longer = _longer(pairs.filter(F.length("last") > 1).select("prev", "last", "n"), open_ends, ["prev"]).withColumnRenamed("n", "n_longer")
    longer1 = _longer(words.filter(F.length("last") > 1).select("last", F.col("n1").alias("n")), open_ends.select("last").distinct(), []).withColumnRenamed("n", "n_longer1")
    stats = open_ends.join(pairs, ["prev", "last"], "left").join(words, "last", "left").join(longer, ["prev", "last"], "left").join(longer1, "last", "left")
    n, e = F.coalesce("n", F.lit(0)), F.coalesce("n_end", F.lit(0))
    n1, e1 = F.coalesce("n1", F.lit(0)), F.coalesce("e1", F.lit(0))
    share = (e + 2 * (e1 + 0.2) / (n1 + 1)) / (n + 2)
    # the last word is hardly known as a word, and longer ones with its beginning are usual here, or anywhere if its place is new
    nl, nl1 = F.coalesce("n_longer", F.lit(0)), F.coalesce("n_longer1", F.lit(0))
    settled = (n >= 8) & (2 * e >= n) & (n1 >= 0.2 * nl) & (nl < 100 * n)
    partial = ((nl > 2 * n) & ~settled) | ((n < 5) & (nl1 > 20 * n1))
    stats = stats.select("prev", "last", F.when(partial, 0.0).otherwise(share).alias("end_share"))
    r = recs.join(stats, ["prev", "last"], "left").withColumn("odd", F.col("certain") | (~F.col("proper") & (F.coalesce("end_share", F.lit(0.0)) < USUAL)))
    r = materialize(r, "ended")
    limits = hidden_limits(r)
    at = (
        r.filter("not proper").select("rec_kind", "rec_key", "feed", F.posexplode("lens").alias("m", "len"))
        .join(limits, ["feed", "m", "len"]).groupBy("rec_kind", "rec_key").agg(F.min("m").alias("m"))
    )
    out = r.join(at, ["rec_kind", "rec_key"], "left")
    name = F.array(*[F.lit(x) for x in MEASURES])
    return out.select("rec_kind", "rec_key", "feed", "certain", "proper", "end_share", F.get(name, F.col("m")).alias("limit_measure"), (F.col("odd") | F.col("m").isNotNull()).alias("cut"))


def hidden_limits(ended: DataFrame, least: int = 5, times: float = 6.0, around: int = 10) -> DataFrame:
    """(feed, m, len, n): lengths at which texts with an odd ending pile up, by feed and measure.

    ``n`` texts stand there, at least ``least`` and ``times`` as many as at the
    mean length within ``around``.
    """
    odd = ended.filter("odd").select("feed", F.posexplode("lens").alias("m", "len")).groupBy("feed", "m", "len").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("feed", "m").orderBy("len").rangeBetween(-around, around)
    near = odd.withColumn("near", (F.sum("n").over(w) - F.col("n")) / (2 * around))
    return near.filter((F.col("n") >= least) & (F.col("n") >= times * F.greatest("near", F.lit(0.5)))).select("feed", "m", "len", "n")


def cut_shares(cut: DataFrame) -> DataFrame:
    """(feed, records, cut_records, cut_share) of a ``cut_records`` result."""
    return cut.groupBy("feed").agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut_records")).withColumn("cut_share", F.round(F.col("cut_records") / F.col("records"), 6))
