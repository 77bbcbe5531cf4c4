"""Evaluation texts inside a training corpus, found by latent semantic retrieval.

The corpus is cut into overlapping passages of words.  Their TF-IDF matrix
over hashed words is reduced by a distributed randomised SVD (passes over the
corpus in which every partition adds its part of a small matrix).  Items are cut alike;
a passage whose latent vector is near one of an item's makes the document a
candidate for the item, and so do shared word pairs, stock or not.  Each
candidate is decided by the longest common subsequence of the item's words
within one or two stretches of the document; only those that two bounds of
this decision rule out (``Bounds``) are left out before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import spread

TAG = re.compile(r"<[^<>]*>")
HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
WORD = re.compile(r"[⺀-鿿]|[^\W_⺀-鿿]+")
PASSAGE, STEP, DIM_BITS, RANK, SEED = 32, 16, 13, 48, 11
D = 1 << DIM_BITS
SHARE, BLOCK_ITEMS = 0.4, 20_000


def words(text: str | None) -> list[str]:
    """Words in lower case without markup, entities, punctuation and line breaks."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    # a tag inside a word parts nothing, one between words does so by the blanks around it
    return WORD.findall(HYPHEN.sub("", TAG.sub(" ", text)).lower())


def _hash(w: str) -> int:
    h = 2166136261
    for b in w.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & (D - 1)


class Hasher(dict):
    """Word to feature; words are few and repeated, so each is hashed once."""

    def __missing__(self, w: str) -> int:
        v = self[w] = _hash(w)
        return v


def passages(n: int) -> list[tuple[int, int]]:
    """Word ranges of PASSAGE words every STEP words; the last one ends with the text."""
    if n <= PASSAGE:
        return [(0, n)] if n else []
    out = [(a, a + PASSAGE) for a in range(0, n - PASSAGE, STEP)]
    return [*out, (n - PASSAGE, n)]


def whole_cover(n: int) -> list[tuple[int, int]]:
    """Word ranges of PASSAGE words that cover the text, overlapping at its end only."""
    if n <= PASSAGE:
        return [(0, n)] if n else []
    return [*((a, a + PASSAGE) for a in range(0, n - PASSAGE, PASSAGE)), (n - PASSAGE, n)]


def _rows(feats: np.ndarray, spans: list[tuple[int, int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length: (row, column, value)."""
    r = np.concatenate([np.full(b - a, i) for i, (a, b) in enumerate(spans)])
    c = np.concatenate([feats[a:b] for a, b in spans])
    key, cnt = np.unique(r * D + c, return_counts=True)
    r, c = key // D, key % D
    v = (1 + np.log(cnt)) * idf[c]
    norm = np.sqrt(np.bincount(r, v * v, len(spans)))
    return r, c, (v / np.maximum(norm[r], 1e-9)).astype(np.float32)


def _project(r, c, v, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]), np.float32)
    for lo in range(0, len(r), 400_000):
        part = slice(lo, lo + 400_000)
        _add_sorted(out, r[part], basis[c[part]] * v[part, None])
    return out


def _add_sorted(out: np.ndarray, r: np.ndarray, x: np.ndarray) -> None:
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    out[r[at]] += np.add.reduceat(x, at, 0)


def _features(texts, hasher: Hasher) -> Iterator[tuple[list[str], np.ndarray]]:
    for t in texts:
        w = words(t)
        yield w, np.fromiter((hasher[x] for x in w), np.int64, len(w))


def _sum_matrix(df: DataFrame, fn, rows: int, cols: int) -> np.ndarray:
    """Sum over all partitions of a rows x cols matrix; ``fn`` maps batches to one matrix.

    Partitions are added up in groups on the executors; a result of fixed size
    comes to the driver.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = fn(batches)
        if m is not None:
            step = max(1, rows // 16)
            for k, lo in enumerate(range(0, rows, step)):
                yield pd.DataFrame({"k": [k], "m": [np.ascontiguousarray(m[lo : lo + step], np.float32).tobytes()]})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in pdf["m"]:
            x = np.frombuffer(bytes(b), np.float32).astype(np.float64)
            total = x if total is None else total + x
        return pd.DataFrame({"k": [key[0]], "m": [total.astype(np.float32).tobytes()]})

    got = df.mapInPandas(part, "k int, m binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("k", "g").applyInPandas(lambda key, pdf: add(key, pdf), "k int, m binary").groupBy("k").applyInPandas(lambda key, pdf: add(key, pdf), "k int, m binary").collect()
    out = np.zeros((rows, cols), np.float32)
    step = max(1, rows // 16)
    for r in got:
        x = np.frombuffer(bytes(r["m"]), np.float32).reshape(-1, cols)
        out[r["k"] * step : r["k"] * step + len(x)] = x
    return out


def latent_basis(docs: DataFrame, text: str, power_steps: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis D x RANK): document frequencies and right singular directions of the corpus' passages."""
    texts = spread(docs.select(F.col(text).alias("t")))

    def count(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
        df, hasher = np.zeros((D, 1), np.float64), Hasher()
        n = 0
        for pdf in batches:
            for _, f in _features(pdf["t"], hasher):
                n += 1
                df[np.unique(f), 0] += 1
        return df if n else None

    n = texts.count()
    freq = _sum_matrix(texts, count, D, 1)[:, 0]
    idf = np.log((n + 1) / (freq + 0.5)).clip(0.05).astype(np.float32)
    basis = np.random.default_rng(SEED).normal(size=(D, RANK)).astype(np.float32)
    for _ in range(power_steps):
        basis = np.linalg.qr(basis)[0].astype(np.float32)

        def gram(batches: Iterator[pd.DataFrame], basis=basis) -> np.ndarray | None:
            out, hasher, seen = np.zeros((D, RANK), np.float32), Hasher(), False
            for pdf in batches:
                spans, feats, at = [], [], 0
                for _, f in _features(pdf["t"], hasher):
                    # windows side by side; the last one ends with the text
                    spans += [(a + at, b + at) for a, b in whole_cover(len(f))]
                    feats.append(f)
                    at += len(f)
                if spans:
                    seen = True
                    r, c, v = _rows(np.concatenate(feats), spans, idf)
                    y = _project(r, c, v, len(spans), basis)
                    o = np.argsort(c, kind="stable")
                    _add_sorted(out, c[o], y[r[o]] * v[o, None])
            return out if seen else None

        basis = _sum_matrix(texts, gram, D, RANK)
    return idf, np.linalg.qr(basis)[0].astype(np.float32)


class ItemWords:
    """Words of an item with what matching needs: a bit set per word and its word pairs, also with one word between."""

    def __init__(self, ws: list[str]):
        self.words = ws
        self.masks: dict[str, int] = {}
        for i, w in enumerate(ws):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.pairs = set(zip(ws, ws[1:])) | set(zip(ws, ws[2:]))

    def lcs(self, doc: list[str]) -> int:
        """Length of the longest common subsequence, bit-parallel over the item's words."""
        full = (1 << len(self.words)) - 1
        v = full
        masks = self.masks
        for w in doc:
            m = masks.get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & full
        return len(self.words) - v.bit_count()


def stretches(item: ItemWords, doc: list[str], gap: int = 12, least: int = 3) -> int:
    """Most words of the item found in order in one or two stretches of ``doc``.

    A stretch is a run of words of the document in which pairs of the item's
    words (next to each other or one apart, in order) follow at most ``gap``
    words apart, at least ``least`` of them.
    """
    pairs, n = item.pairs, len(doc)
    runs: list[list[int]] = []
    for j in range(n - 1):
        w = doc[j]
        if w not in item.masks:
            continue
        e = j + 1 if (w, doc[j + 1]) in pairs else j + 2 if j + 2 < n and (w, doc[j + 2]) in pairs else 0
        if e:
            if runs and j - runs[-1][1] <= gap:
                runs[-1][1], runs[-1][2] = e, runs[-1][2] + 1
            else:
                runs.append([j, e, 1])
    if not runs and len(item.words) == 1:
        return int(item.words[0] in doc)
    runs = [r for r in runs if r[2] >= min(least, max(1, len(item.words) - 1))]
    if not runs:
        return 0
    # two stretches hold no longer a subsequence than both of them alone
    parts = sorted(((item.lcs(doc[a : b + 1]), doc[a : b + 1]) for a, b, _ in runs), key=lambda x: -x[0])
    top = parts[0][0]
    for i, (nx, x) in enumerate(parts):
        if 2 * nx <= top:
            break
        for ny, y in parts[i + 1 :]:
            if nx + ny <= top:
                break
            top = max(top, item.lcs(x + y), item.lcs(y + x))
    return top


class Bounds:
    """Items that ``stretches`` can find in a document; no item it would find is left out.

    A stretch holds ``least`` pairs of the item's words, so the document does;
    and a common subsequence is no longer than the item's words the document has.
    """

    def __init__(self, items: list[ItemWords], least: int = 3):
        self.n = len(items)
        size = np.array([len(m.words) for m in items], np.int64)
        self.least = np.minimum(least, np.maximum(1, size - 1))
        self.single, self.need = size == 1, SHARE * size
        pairs: dict[tuple[str, str], list[int]] = {}
        having: dict[str, list[tuple[int, int]]] = {}
        for k, m in enumerate(items):
            for p in m.pairs:
                pairs.setdefault(p, []).append(k)
            for w, mask in m.masks.items():
                having.setdefault(w, []).append((k, mask.bit_count()))
        self.pairs = {p: np.array(ks) for p, ks in pairs.items()}
        self.having = {w: tuple(np.array(x).T) for w, x in having.items()}

    def candidates(self, doc: list[str], near: list[int]) -> list[int]:
        """Items that ``doc`` shares enough pairs with or is ``near``, and has enough words of."""
        pairs, having = self.pairs, self.having
        hits = [pairs[p] for p in zip(doc, doc[1:]) if p in pairs] + [pairs[p] for p in zip(doc, doc[2:]) if p in pairs]
        count = np.bincount(np.concatenate(hits), minlength=self.n) if hits else np.zeros(self.n, np.int64)
        chosen = (count >= self.least) | self.single
        chosen[near] = True
        if not chosen.any():
            return []
        words_of = np.zeros(self.n, np.int64)
        for w in set(doc):
            if w in having:
                k, times = having[w]
                words_of[k] += times
        return np.flatnonzero(chosen & (words_of >= self.need)).tolist()


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", floor: float = 0.4) -> DataFrame:
    """(doc_id, item_id, words, share, answer): documents and the items they leak.

    The items are the held-out side; they go in blocks of about BLOCK_ITEMS, each
    broadcast once and held against all documents, which are read whole.
    ``share`` is the part of the item's words found, ``answer`` whether its last
    ten words are among the text.  Null and empty texts leak nothing; repeated
    documents are judged alike.
    """
    listed = items.select("item_id", F.col(text).alias("t")).filter("t is not null and item_id is not null")
    blocks = max(1, -(-listed.count() // BLOCK_ITEMS))
    idf, basis = latent_basis(docs, text)
    out = None
    for b in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else listed
        found = _block_leaks(docs, part.collect(), idf, basis, text, floor)
        out = found if out is None else out.unionByName(found)
    return out


def _block_leaks(docs: DataFrame, rows: list, idf: np.ndarray, basis: np.ndarray, text: str, floor: float) -> DataFrame:
    """``leaks`` for one block of items."""
    ids = [r["item_id"] for r in rows]
    item_words = [words(r["t"]) for r in rows]
    hasher = Hasher()
    spans, feats, owner, at = [], [], [], 0
    for k, w in enumerate(item_words):
        p = passages(len(w))
        spans += [(a + at, b + at) for a, b in p]
        owner += [k] * len(p)
        feats.append(np.fromiter((hasher[x] for x in w), np.int64, len(w)))
        at += len(w)
    if not spans:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "0 words", "0D share", "false answer")
    owner = np.array(owner)
    r, c, v = _rows(np.concatenate(feats), spans, idf)
    latent = _project(r, c, v, len(spans), basis)
    latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
    matchers = [ItemWords(w) for w in item_words]
    bounds = Bounds(matchers)
    schema = "doc_id long, item_id long, words int, share double, answer boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            docs_w, feats, spans, own, at = [], [], [], [], 0
            for k, (w, f) in enumerate(_features(pdf["t"], hasher)):
                docs_w.append(w)
                p = passages(len(w))
                spans += [(a + at, b + at) for a, b in p]
                own += [k] * len(p)
                feats.append(f)
                at += len(w)
            out = []
            if spans:
                r, c, v = _rows(np.concatenate(feats), spans, idf)
                y = _project(r, c, v, len(spans), basis)
                y /= np.maximum(1e-9, np.linalg.norm(y, axis=1, keepdims=True))
                cand: set[tuple[int, int]] = set()
                own_a = np.array(own)
                for lo in range(0, len(y), 4096):
                    i, j = np.nonzero(y[lo : lo + 4096] @ latent.T >= floor)
                    cand.update(zip(own_a[lo + i].tolist(), owner[j].tolist()))
                near: dict[int, list[int]] = {}
                for d, k in cand:
                    near.setdefault(d, []).append(k)
                for d, k in ((d, k) for d in range(len(docs_w)) for k in bounds.candidates(docs_w[d], near.get(d, []))):
                    n = stretches(matchers[k], docs_w[d])
                    if n >= SHARE * len(item_words[k]):
                        tail = item_words[k][-10:]
                        text_d = " ".join(docs_w[d])
                        out.append((pdf["doc_id"].iloc[d], ids[k], n, n / len(item_words[k]), " ".join(tail) in text_d))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "share", "answer"])

    return spread(docs.select("doc_id", F.col(text).alias("t"))).mapInPandas(run, schema)
