"""Admission of new rows: separation gate, separation index, idempotent insert."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import stages as S
from memloom.functions.text import rich_tokens, word_set
from memloom.operators.order import numbered, windows_before


class _Recent:
    """Sets of the rows before, and how many elements each shares with a new set."""

    def __init__(self, size: int):
        self.size, self.lists, self.lens = size, {}, {}

    def shared(self, place: int, elements: list) -> np.ndarray:
        """Shared elements with the rows at places ``place - size`` to ``place - 1``, earliest first."""
        lo = place - self.size
        hit = []
        for e in elements:
            at = self.lists.get(e)
            if at is not None:
                k = bisect_left(at, lo) if at[0] < lo else 0
                if k < len(at):
                    hit.append(np.frombuffer(at, np.int64)[k:].copy())
        return np.bincount(np.concatenate(hit) - lo, minlength=self.size) if hit else np.zeros(self.size, np.int64)

    def add(self, place: int, elements: list) -> None:
        for e in elements:
            self.lists.setdefault(e, array("q")).append(place)
        self.lens[place] = len(elements)

    def sizes(self, place: int) -> np.ndarray:
        get = self.lens.get
        return np.array([get(p, 0) for p in range(place - self.size, place)], np.int64)


def _assess(window: int):
    """Largest word Jaccard (earliest of equal ones) and separation of every row against the ``window`` rows before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, words, feats, ids = None, None, None, {}
        for pdf in batches:
            out = []
            for scope, chunk, own, place, rid, ws, fs in zip(*(pdf[c].tolist() for c in ("scope", "_chunk", "_own", "ord", "id", "ws", "fs"))):
                if (scope, chunk) != last:
                    last, words, feats, ids = (scope, chunk), _Recent(window), _Recent(window), {}
                ws, fs = ([] if ws is None else list(ws)), ([] if fs is None else list(fs))
                if own:
                    i, n = words.shared(place, ws), words.sizes(place)
                    j = np.where((n > 0) & (len(ws) > 0), i / np.maximum(1, n + len(ws) - i), 0.0)
                    at = int(np.round(j, 9).argmax())
                    i, n = feats.shared(place, fs), feats.sizes(place)
                    # every token is two features; a separator is in no other row
                    u = np.maximum(1, 2 * (n + len(fs) - i))
                    worst = [float((2 * i / (u + k)).max()) for k in range(S.SEPARATORS + 1)]
                    k = next((k for k, x in enumerate(worst) if x <= S.OVERLAP_LIMIT), S.SEPARATORS)
                    peer = ids.get(place - window + at) if j[at] > 0 else None
                    out.append((rid, peer, float(j[at]) if peer else 0.0, worst[0], k, worst[k], 1 - worst[k]))
                words.add(place, ws), feats.add(place, fs)
                ids[place] = rid
            yield pd.DataFrame(out, columns=["engram_id", "peer", "jaccard", "overlap", "separators", "overlap_after", "separation"])

    return run


def assess(rows: DataFrame, scope: str = "tenant_id", seq: str = "encoded_at_tick", window: int = S.GATE_WINDOW) -> DataFrame:
    """(engram_id, peer, jaccard, overlap, separators, overlap_after, separation) of every row against the ``window`` rows before it in its scope.

    ``peer`` is the row of the largest word Jaccard, the earliest of equal
    ones (null without a shared word).  ``overlap`` is the largest Jaccard of
    features, ``separators`` the number (0-6) of features of its own that bring
    it to the limit, ``separation`` what is left apart.  Rows before count with
    their own features, without separators.  Null scopes form one scope; scopes
    are cut into chunks, so no task holds more than a chunk and its border.
    """
    r = rows.select(F.col(scope).alias("scope"), F.col(seq).alias("seq"), F.col("engram_id").alias("id"), word_set(F.col("content")).alias("ws"), rich_tokens(F.col("content"), F.col("context"), F.col("outcome")).alias("fs"))
    n = numbered(r, "scope", [F.col("seq").asc_nulls_first(), F.col("id").asc()])
    w = windows_before(n, "scope", window)
    return w.select("scope", "_chunk", "_own", "ord", "id", "ws", "fs").mapInPandas(_assess(window), "engram_id string, peer string, jaccard double, overlap double, separators int, overlap_after double, separation double")


def _free() -> Column:
    return F.coalesce(F.col("provenance.verified"), F.lit(False)) | F.coalesce(F.col("context").startswith("ledger:"), F.lit(False))


def snapshot_gate(rows: DataFrame, scope: str = "tenant_id", seq: str = "encoded_at_tick") -> DataFrame:
    """(engram_id, peer, jaccard, verdict) of rows near one of the 512 before them, whatever became of those."""
    near = assess(rows, scope, seq).filter(F.round("jaccard", 9) >= S.REVIEW).select(F.col("engram_id").alias("id"), "peer", F.round("jaccard", 9).alias("jaccard"))
    sep = rows.select(F.col("engram_id").alias("peer"), F.coalesce(F.col("separation_index").cast("double"), F.lit(0.0)).alias("sep"))
    free = rows.select(F.col("engram_id").alias("id"), _free().alias("free"))
    out = near.join(sep, "peer").join(free, "id")
    bad = (F.col("jaccard") >= S.REJECT) | (F.greatest("sep", 1 - F.col("jaccard")) < S.MIN_SEPARATION)
    return out.select(F.col("id").alias("engram_id"), "peer", "jaccard", F.when(F.col("free"), "accept").when(bad, "reject").otherwise("accept").alias("verdict"))


def near_sets(sets: DataFrame, floor: float, by: str = "scope", key: str = "cls", elements: str = "ws") -> DataFrame:
    """(by, a, b, jaccard): pairs of different sets of one scope with Jaccard ``floor`` or more, both ways.

    Sets are distinct, so copies of a row never meet here.  Pairs meet on an
    element among the ceil((1 - floor) n) + 1 rarest of both; sizes must fit.
    """
    t = sets.select(by, key, F.size(elements).alias("n"), F.explode(elements).alias("w"))
    df = t.groupBy(by, "w").agg(F.count(F.lit(1)).alias("df"))
    ranked = t.join(df, [by, "w"]).groupBy(by, key).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    k = (F.floor((1 - floor) * F.col("n")) + 1).cast("int")
    pre = ranked.select(by, key, "n", F.explode(F.slice("ws", 1, k)).alias("p")).select(by, key, "n", F.col("p.w").alias("w"))
    a, b = pre.select(by, F.col(key).alias("a"), F.col("n").alias("na"), "w"), pre.select(by, F.col(key).alias("b"), F.col("n").alias("nb"), "w")
    pairs = a.join(b, [by, "w"]).filter((F.col("a") != F.col("b")) & (F.col("nb") >= floor * F.col("na")) & (F.col("na") >= floor * F.col("nb"))).select(by, "a", "b").distinct()
    x = sets.select(by, F.col(key).alias("a"), F.col(elements).alias("xa"))
    y = sets.select(by, F.col(key).alias("b"), F.col(elements).alias("xb"))
    i = F.size(F.array_intersect("xa", "xb"))
    j = F.round(i / (F.size("xa") + F.size("xb") - i), 9)
    return pairs.join(x, [by, "a"]).join(y, [by, "b"]).select(by, "a", "b", j.alias("jaccard")).filter(F.col("jaccard") >= floor)


def _walk(window: int):
    """Verdicts of rows in order, against the last ``window`` accepted of their scope; ``ws`` holds hashes of a row's words.

    A word knows its accepted rows as the bits of one number.  A row near
    enough may miss only so many words, so it holds one of any that number and
    one more: those in the fewest accepted rows.
    """
    names = ["engram_id", "peer", "jaccard", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row accepted as number n has bit n % window until n + window is
        last, n, kept, holders = None, 0, {}, {}
        for b in batches:
            peers, best_of, oks = [], [], []
            for scope, rid, free, sep, ws in zip(*(b[c].to_pylist() for c in ("scope", "id", "free", "sep", "ws"))):
                if scope != last:
                    last, n, kept, holders = scope, 0, {}, {}
                best = None
                if ws:
                    own = len(ws)
                    miss = own - ceil((S.REVIEW - 1e-9) * own)
                    masks = [m for w in ws if (m := holders.get(w))]
                    miss -= own - len(masks)
                    if miss >= 0:
                        masks.sort(key=int.bit_count)
                        bits = 0
                        for m in masks[: miss + 1]:
                            bits |= m
                        mine = set(ws) if bits else None
                        while bits:
                            low = bits & -bits
                            bits ^= low
                            at, osep, oid, others = kept[low.bit_length() - 1]
                            i = len(mine & others)
                            j = round(i / (own + len(others) - i), 9)
                            # of equal ones the earliest accepted
                            if j >= S.REVIEW and (best is None or (j, -at) > best[:2]):
                                best = (j, -at, osep, oid)
                ok = bool(free) or best is None or not (best[0] >= S.REJECT or max(best[2], 1 - best[0]) < S.MIN_SEPARATION)
                if ok:
                    slot = n % window
                    bit = 1 << slot
                    if slot in kept:
                        for w in kept[slot][3]:
                            if m := holders[w] ^ bit:
                                holders[w] = m
                            else:
                                del holders[w]
                    kept[slot] = (n, sep, rid, frozenset(ws or ()))
                    for w in ws or ():
                        holders[w] = holders.get(w, 0) | bit
                    n += 1
                peers.append(best[3] if best else None), best_of.append(best[0] if best else None), oks.append(ok)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(peers, pa.string()), pa.array(best_of, pa.float64()), pa.array(oks, pa.bool_())], names)

    return run


def ordered_gate(rows: DataFrame, scope: str = "tenant_id", seq: str = "encoded_at_tick", window: int = S.GATE_WINDOW) -> DataFrame:
    """(engram_id, peer, jaccard, accepted): verdicts in order; a row meets only rows accepted before it, the last ``window`` of them.

    Every scope streams in order through a walk that holds the words of the
    last ``window`` accepted rows; no pair of rows becomes a table row, and
    only the texts move, once.  Words count by 64-bit hashes.
    """
    r = rows.select(F.coalesce(scope, F.lit("")).alias("scope"), F.col(seq).alias("seq"), F.col("engram_id").alias("id"), _free().alias("free"), F.coalesce(F.col("separation_index").cast("double"), F.lit(0.0)).alias("sep"), "content")
    r = r.repartition("scope").sortWithinPartitions("scope", F.col("seq").asc_nulls_first(), "id")
    r = r.select("scope", "id", "free", "sep", F.transform(word_set(F.col("content")), lambda w: F.xxhash64(w)).alias("ws"))
    return r.mapInArrow(_walk(window), "engram_id string, peer string, jaccard double, accepted boolean")


def separation_index(rows: DataFrame, scope: str = "tenant_id", seq: str = "encoded_at_tick") -> DataFrame:
    """(engram_id, overlap, separators, separation) of every row, also of those that overlap with none."""
    return assess(rows, scope, seq).select("engram_id", "overlap", "separators", "separation")


def insert_once(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunk rows whose (doc_id, chunk_id) is not stored yet; within the batch the smallest id of a key comes first."""
    key = ["doc_id", "chunk_id"]
    first = new.filter("doc_id is not null and chunk_id is not null").groupBy(*key).agg(F.min("episode_id").alias("episode_id"))
    return first.join(stored.select(*key).distinct(), key, "left_anti").select("episode_id", *key)
