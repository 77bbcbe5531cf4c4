"""The k best rows of every cue of a batch, by blocks: rows stay where they lie, only k a cue and partition are shuffled.

A batch of cues is a bounded thing; larger ones go in blocks of BLOCK_CUES.
Each task scores a row against all cues of the block at once (a weighted count
over the cue lists of its words, or a matrix product), keeps the k best of each
cue and gives back no more than those.  Nothing is left out: a row that is not
among the k best of its partition is not among the k best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK_CUES = 4096


def cue_blocks(cues: DataFrame) -> Iterator[list]:
    """The rows of ``cues``, at most about BLOCK_CUES at a time."""
    n = cues.count()
    blocks = max(1, -(-n // BLOCK_CUES))
    for b in range(blocks):
        part = cues if blocks == 1 else cues.filter(F.pmod(F.xxhash64("cue_id"), F.lit(blocks)) == b)
        yield part.collect()


class Best:
    """The k best (score, id) of every cue so far: higher scores first, of equal ones the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.cue: list[np.ndarray] = []
        self.score: list[np.ndarray] = []
        self.id: list[np.ndarray] = []
        self.waiting = 0
        self.limit = max(200_000, 4 * n * k)

    def add(self, cue: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.floor[cue]
        if ok.any():
            self.cue.append(cue[ok]), self.score.append(score[ok]), self.id.append(ids[ok])
            self.waiting += int(ok.sum())
            if self.waiting > self.limit:
                self.cut()

    def cut(self) -> pd.DataFrame:
        if not self.cue:
            return pd.DataFrame({"cue": [], "score": [], "id": []})
        cue, score, ids = np.concatenate(self.cue), np.concatenate(self.score), np.concatenate(self.id)
        o = np.lexsort((ids.astype(str) if ids.dtype == object else ids, -np.round(score, 9), cue))
        cue, score, ids = cue[o], score[o], ids[o]
        place = np.arange(len(cue)) - np.searchsorted(cue, cue, "left")
        keep = place < self.k
        full = place == self.k - 1
        self.floor[cue[full]] = np.round(score[full], 9) - 1e-9
        cue, score, ids = cue[keep], score[keep], ids[keep]
        self.cue, self.score, self.id, self.waiting = [cue], [score], [ids], len(cue)
        return pd.DataFrame({"cue": cue, "score": score, "id": ids})


def best_rows(rows: DataFrame, block: list, k: int, score: Callable, id_col: str = "engram_id") -> DataFrame:
    """(cue_id, id_col, score): the k best rows of each cue.

    ``score(pdf)`` yields (cue numbers, scores, row ids) for a batch of ``rows``.
    """
    names = [c["cue_id"] for c in block]
    kind, cue_kind = rows.schema[id_col].dataType.simpleString(), "long" if names and isinstance(names[0], int) else "string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(names), k)
        for pdf in batches:
            for cue, s, ids in score(pdf):
                best.add(cue, s, ids)
        out = best.cut()
        if len(out):
            yield pd.DataFrame({"cue_id": [names[c] for c in out["cue"].astype(int)], id_col: out["id"], "score": out["score"].astype(float)})

    part = rows.mapInPandas(run, f"cue_id {cue_kind}, {id_col} {kind}, score double")
    w = W.partitionBy("cue_id").orderBy(F.desc(F.round("score", 9)), F.col(id_col))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def word_scorer(lists: dict[str, tuple[np.ndarray, np.ndarray]], n: int, weigh: Callable | None = None, allowed: dict | None = None, id_col: str = "engram_id") -> Callable:
    """Scores rows with a column ``ws`` of words: the sum over its words of the cue lists' weights.

    ``weigh(words, row)`` may give a factor for each word; ``allowed`` maps a
    row's ``agent_id`` to the cues that may see it, all others see none.
    """

    def run(pdf: pd.DataFrame):
        none = np.zeros(0, np.int64)
        agents = pdf["agent_id"].tolist() if allowed is not None else None
        for r, (rid, ws) in enumerate(zip(pdf[id_col].tolist(), pdf["ws"].tolist())):
            if ws is None:
                continue
            hit = [w for w in ws if w in lists]
            if not hit:
                continue
            idx = np.concatenate([lists[w][0] for w in hit])
            if weigh is None:
                val = np.concatenate([lists[w][1] for w in hit])
            else:
                val = np.concatenate([lists[w][1] * f for w, f in zip(hit, weigh(hit, pdf, r))])
            total = np.bincount(idx, val, n)
            at = np.flatnonzero(total > 0)
            if agents is not None:
                at = np.intersect1d(at, allowed.get(agents[r], none), assume_unique=True)
            yield at, total[at], np.full(len(at), rid, dtype=object if isinstance(rid, str) else np.int64)

    return run


def vector_scorer(cues: list, dim: int, floor: float, vec: str = "vec", id_col: str = "engram_id", skip_same: bool = False) -> Callable:
    """Scores rows by cosine with the cues' ``vector``, over ``floor``; vectors of another length have none."""
    have = [(i, c["vector"]) for i, c in enumerate(cues) if c["vector"] is not None and len(c["vector"]) == dim]
    number = np.array([i for i, _ in have], np.int64)
    names = np.array([cues[i]["cue_id"] for i, _ in have], dtype=object)
    q = np.array([v for _, v in have], np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.where(np.isfinite(norm) & (norm > 1e-4), q / norm, 0.0)

    def run(pdf: pd.DataFrame):
        if not len(number):
            return
        ok = [i for i, v in enumerate(pdf[vec].tolist()) if v is not None and len(v) == dim]
        if not ok:
            return
        v = np.stack(pdf[vec].iloc[ok].to_list()).astype(np.float64)
        with np.errstate(all="ignore"):
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(np.isfinite(n) & (n > 1e-4), v / n, 0.0)
        ids = pdf[id_col].to_numpy()[ok]
        for lo in range(0, len(v), 512):
            s = np.clip(v[lo : lo + 512] @ q.T, -1, 1)
            i, j = np.nonzero(s > floor)
            if skip_same:
                other = ids[lo + i] != names[j]
                i, j = i[other], j[other]
            yield number[j], s[i, j], ids[lo + i]

    return run
