"""Personal information in free text: found by the character tagger, replaced by typed placeholders.

Every character of every text is read by the bidirectional LSTM.  Texts longer
than a window are cut into overlapping ones; where windows overlap, each
position takes the tag of the window in which it lies deeper, and spans are
read off the reconciled tags of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import spread
from memloom.llm.pii_model import Tagger, codes, spans_of

WINDOW, CONTEXT, CELLS = 1024, 64, 240_000
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def windows(n: int) -> list[tuple[int, int]]:
    """Windows of at most WINDOW characters that cover a text of ``n``, neighbours sharing 2 * CONTEXT."""
    out, a = [], 0
    while n - a > WINDOW:
        out.append((a, a + WINDOW))
        a += WINDOW - 2 * CONTEXT
    return [*out, (a, n)] if n else []


def _valid(kind: str, s: str) -> bool:
    """An exact check of what a value of its type must at least hold."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    if kind == "email":
        return letters >= 4 and len(s) >= 6 and bool(re.search(r"[@＠]|\bat\b", s, re.I))
    if kind == "phone":
        return 7 <= digits <= 16 and letters <= 3
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits >= 1 and letters >= 4
    return letters >= 2 and not digits


def find_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of every text."""
    coded = [codes(t) for t in texts]
    jobs = sorted(((i, a, b) for i, c in enumerate(coded) for a, b in windows(len(c))), key=lambda j: j[2] - j[1])
    paths: list[np.ndarray] = []
    lo = 0
    while lo < len(jobs):
        # windows of like length together, CELLS characters at a time
        hi = lo + 1
        while hi < len(jobs) and (hi - lo + 1) * (jobs[hi][2] - jobs[hi][1]) <= CELLS:
            hi += 1
        n = np.array([b - a for _, a, b in jobs[lo:hi]])
        X = np.zeros((hi - lo, int(n.max())), np.uint8)
        for k, (i, a, b) in enumerate(jobs[lo:hi]):
            X[k, : b - a] = coded[i][a:b]
        paths += tagger.viterbi(tagger.emissions(np.ascontiguousarray(X.T), n), n)
        lo = hi
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (i, _, _), path in zip(jobs, paths):
        if i not in tags and path.any():
            tags[i] = (np.zeros(len(coded[i]), np.int8), np.full(len(coded[i]), -1, np.int32))
    for (i, a, b), path in zip(jobs, paths):
        if i not in tags:
            continue
        t, depth = tags[i]
        x = np.arange(b - a)
        d = np.minimum(x if a else x + WINDOW, (b - a - 1 - x) if b < len(coded[i]) else WINDOW + x[::-1]).astype(np.int32)
        deeper = d > depth[a:b]
        t[a:b][deeper], depth[a:b][deeper] = path[deeper], d[deeper]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, (t, _) in tags.items():
        got = []
        for a, b, kind in spans_of(t):
            if got and got[-1][2] == kind and a - got[-1][1] <= 1 and kind != "person_name":
                a = got.pop()[0]
            got.append((a, b, kind))
        out[i] = [s for s in got if _valid(s[2], INVISIBLE.sub("", texts[i][s[0] : s[1]]))]
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def find_pii(rows: DataFrame, text: str, keep: list[str], redacted: bool = True) -> DataFrame:
    """``keep`` columns and, where anything was found, spans and the text with placeholders.

    Adds spans array<struct<start,end,pii_type>> and redacted (null if not
    asked for).  Null and empty texts have no spans and stay as they are.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    schema += ", spans array<struct<start:int,end:int,pii_type:string>>, redacted string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load()
        for pdf in batches:
            texts = [t or "" for t in pdf["_t"]]
            found = find_spans(tagger, texts)
            out = pdf.drop(columns="_t")
            out["spans"] = [[{"start": a, "end": b, "pii_type": k} for a, b, k in s] for s in found]
            out["redacted"] = [redact(t, s) if s else raw for t, s, raw in zip(texts, found, pdf["_t"])] if redacted else None
            yield out

    return spread(rows.select(*keep, F.col(text).alias("_t"))).mapInPandas(run, schema)


