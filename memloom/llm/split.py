"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text starts as atomic segments that end at its boundaries (paragraph, line,
sentence, clause, word).  Adjacent pairs wait in a heap ordered by the
strength of the boundary between them; the weakest boundary is merged first
while the merged segment plus its overlap fits the limit.  What remains are
the bodies of the pieces; each piece starts with the ``overlap`` code points
before its body.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundary strengths: the end of a match is a boundary (fixed values, strongest first).
BOUNDARIES = (
    (6, re.compile(r"\n[ \t\r]*\n\s*")),
    (5, re.compile(r"\n\s*")),
    (4, re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*")),
    (3, re.compile(r"[;:,–—]\s+|[，、；：]")),
    (2, re.compile(r"\s+")),
)
COMBINING = re.compile(r"[̀-ͯ᪰-᫿⃐-⃿︀-️‍🏻-🏿]")


def _cuts(text: str, lo: int, hi: int, level: int) -> list[int]:
    rx = BOUNDARIES[level][1]
    return [m.end() for m in rx.finditer(text, lo, hi) if lo < m.end() < hi]


def atoms(text: str, room: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of segments of at most ``room`` code points.

    A segment is only cut at a weaker boundary, or at last inside a word, when
    it is longer than ``room``; weaker boundaries inside a segment that fits
    would be the first to be merged away again.
    """
    out: list[tuple[int, int]] = []

    def cut(lo: int, hi: int, level: int, strength: int) -> None:
        stack = [(lo, hi, level, strength)]
        while stack:
            lo, hi, level, strength = stack.pop()
            if level >= 3 and hi - lo <= room:
                out.append((hi, strength))
            elif level == len(BOUNDARIES):
                ends = list(range(lo + room, hi, room))
                pos = lo
                for e in ends:
                    e = pos + room
                    if e >= hi:
                        break
                    back = e
                    while back > pos + 1 and COMBINING.match(text[back]):
                        back -= 1
                    e = back if back > pos + 1 else e
                    out.append((e, 0))
                    pos = e
                while hi - pos > room:
                    pos += room
                    out.append((pos, 0))
                out.append((hi, strength))
            else:
                ends = [*_cuts(text, lo, hi, level), hi]
                starts = [lo, *ends[:-1]]
                s = BOUNDARIES[level][0]
                for a, b in reversed(list(zip(starts, ends))):
                    stack.append((a, b, level + 1, strength if b == hi else s))

    cut(0, len(text), 0, 9)
    return out


def split(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece; start..end holds at most ``max_chars`` code points.

    A text within the limit is one piece, an empty one as well.  ``overlap`` is
    at most ``max_chars`` - 1; where less text lies before, the overlap is that.
    """
    n = len(text)
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    overlap = max(0, min(overlap, max_chars - 1))
    if n <= max_chars:
        return [(0, 0, n)]
    room = max_chars - overlap
    seg = atoms(text, room)
    ends, strength = [e for e, _ in seg], [s for _, s in seg]
    m = len(ends)
    start = [0, *ends[:-1]]
    nxt, prv, alive = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m

    def fits(a: int, b: int) -> bool:
        return ends[b] - start[a] + min(overlap, start[a]) <= max_chars

    heap = [(strength[i], ends[i + 1] - start[i], i, ends[i], ends[i + 1]) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, e1, e2 = heapq.heappop(heap)
        j = nxt[i] if alive[i] else m
        if j >= m or ends[i] != e1 or ends[j] != e2 or start[i] != e2 - size or not fits(i, j):
            continue
        ends[i], strength[i], alive[j] = ends[j], strength[j], False
        nxt[i] = nxt[j]
        if nxt[i] < m:
            prv[nxt[i]] = i
            k = nxt[i]
            heapq.heappush(heap, (strength[i], ends[k] - start[i], i, ends[i], ends[k]))
        p = prv[i]
        if p >= 0:
            heapq.heappush(heap, (strength[p], ends[i] - start[p], p, ends[p], ends[i]))
    return [(max(0, start[i] - overlap), start[i], ends[i]) for i in range(m) if alive[i]]


PIECES = "piece_no int, n_pieces int, start int, body_start int, end int, piece string"


def split_rows(rows: DataFrame, text: str, limit: str, overlap: str, keep: list[str]) -> DataFrame:
    """Pieces of every row of ``rows``: the ``keep`` columns and piece_no, n_pieces, start, body_start, end, piece.

    A null text gives no piece; a null or non-positive limit leaves the text whole.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", " + PIECES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            idx, out = [], []
            for i, (t, m, o) in enumerate(zip(pdf["_text"], pdf["_limit"], pdf["_overlap"])):
                if t is None:
                    continue
                whole = m is None or m != m or m < 1
                parts = [(0, 0, len(t))] if whole else split(t, int(m), 0 if o is None or o != o else int(o))
                for k, (a, b, e) in enumerate(parts):
                    idx.append(i)
                    out.append((k, len(parts), a, b, e, t[a:e]))
            res = pdf[keep].iloc[idx].reset_index(drop=True)
            got = pd.DataFrame(out, columns=["piece_no", "n_pieces", "start", "body_start", "end", "piece"])
            yield pd.concat([res, got], axis=1)

    return rows.select(*keep, F.col(text).alias("_text"), F.col(limit).cast("long").alias("_limit"), F.col(overlap).cast("long").alias("_overlap")).mapInPandas(run, schema)


def kind_of(context: Column, known: list[str]) -> Column:
    """Kind of an episode: what stands before the first colon of its context, if listed, else ``other``."""
    before = F.lower(F.regexp_replace(F.substring_index(context, ":", 1), r"^[\s ]+|[\s ]+$", ""))
    return F.when(context.contains(":") & before.isin(known), before).otherwise(F.lit("other"))


def split_episodes(episodes: DataFrame, size_limits: DataFrame, most_kinds: int = 10_000) -> DataFrame:
    """Pieces of all episodes under the limit of their kind.

    chunk_id of a piece is ``<doc_id>#<chunk_id>@<episode_id>/<piece_no>`` with
    ``%``, ``#``, ``@`` and ``/`` in the parts escaped, so it leads back to the
    episode and its reference even where several episodes share one.  Texts
    within their limit stay on the JVM side as one piece.
    """
    limits = {r["kind"]: (r["max_chars"], r["overlap_chars"]) for r in size_limits.filter("kind is not null").limit(most_kinds + 1).collect()}
    if len(limits) > most_kinds:
        raise ValueError(f"size_limits has more than {most_kinds} kinds")
    kinds = [k for k in limits if k != "other"]
    pick = lambda j: F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[j])])[F.col("kind")] if limits else F.lit(None)
    e = episodes.select("episode_id", kind_of(F.col("context"), kinds).alias("kind"), F.col("rag.doc_id").alias("doc_id"), F.col("rag.chunk_id").alias("source_chunk_id"), "content")
    e = e.withColumn("max_chars", pick(0).cast("int")).withColumn("overlap_chars", pick(1).cast("int"))
    keep = ["episode_id", "kind", "doc_id", "source_chunk_id", "max_chars", "overlap_chars"]
    over = F.coalesce(F.col("max_chars") >= 1, F.lit(False)) & (F.char_length("content") > F.col("max_chars"))
    whole = e.filter(~over & F.col("content").isNotNull()).select(*keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.lit(0).alias("body_start"), F.char_length("content").alias("end"), F.col("content").alias("piece"))
    pieces = split_rows(e.filter(over), "content", "max_chars", "overlap_chars", keep).unionByName(whole)
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "%", "%25"), "#", "%23"), "@", "%40"), "/", "%2F")
    return pieces.withColumn("chunk_id", F.concat(esc(F.col("doc_id")), F.lit("#"), esc(F.col("source_chunk_id")), F.lit("@"), F.col("episode_id").cast("string"), F.lit("/"), F.col("piece_no").cast("string")))
