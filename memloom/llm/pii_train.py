"""Trains the tagger: ``python -m memloom.llm.pii_train LABELS.jsonl OUT.npz SECONDS [START.npz]``.

Adam on the CRF likelihood with back-propagation through time, all in numpy,
by one process per core whose parameters are averaged after every few steps.
LABELS holds at most MAX_ROWS lines [text, [[start, end, type], ...]], the
documented bound of the labelled sample; ``label`` makes it from tables and an
earlier model.  A third of each batch are such rows; in the others generated
values stand between sentences of rows without personal data.
"""

from __future__ import annotations

import json
import multiprocessing as mp
import os
import random
import re
import sys
import time
from pathlib import Path

import numpy as np

from memloom.llm.pii_data import TYPES, labelled_text
from memloom.llm.pii_model import N_SYMBOLS, TAGS, Tagger, codes, spans_of

MAX_ROWS, H, T, EMB, SEED = 40_000, 28, 128, 24, 7


def label(table_dir: str, model: str, out: str) -> None:
    """Rows of the tables, labelled by an earlier model."""
    import pyarrow.parquet as pq

    from memloom.llm.pii import find_spans

    rows = [x for t, c in (("episodes", "content"), ("handoffs", "summary"), ("documents", "text")) for x in pq.read_table(f"{table_dir}/{t}.parquet", columns=[c])[c].to_pylist() if x]
    rows = random.Random(SEED).sample(rows, min(len(rows), MAX_ROWS))
    with open(out, "w") as f:
        for t, s in zip(rows, find_spans(Tagger.load(Path(model)), rows)):
            f.write(json.dumps([t, s]) + "\n")


def labelled_rows(path: str) -> tuple[list[str], list[tuple[str, list]]]:
    """(rows without personal data, rows with it) of a LABELS file."""
    with open(path) as f:
        rows = [json.loads(x) for _, x in zip(range(MAX_ROWS), f)]
    return [t for t, s in rows if not s], [(t, [tuple(x) for x in s]) for t, s in rows if s]


def cased(r: random.Random, s: str) -> str:
    k = r.random()
    if k > 0.92:
        return re.sub(" ", lambda _: r.choice([" ", " ", "  ", "\t", "\n", "\u00a0"]), s)
    return s.upper() if k < 0.03 else s.lower() if k < 0.06 else s.title() if k < 0.09 and len(s.title()) == len(s) else s


def batch(r: random.Random, bg: list[str], n: int, known: list | None = None):
    X, Y, M = np.zeros((T, n), np.uint8), np.zeros((T, n), np.int8), np.zeros((T, n), np.float32)
    for j in range(n):
        k = r.random()
        if known and k < 0.2:
            text, spans = r.choice(known)
        elif k < 0.33:
            text, spans = cased(r, r.choice(bg)), []
        else:
            text, spans = labelled_text(r, cased(r, r.choice(bg)))
        tags = np.zeros(len(text), np.int8)
        for a, b, kind in spans:
            k = 1 + 2 * TYPES.index(kind)
            tags[a], tags[a + 1 : b] = k, k + 1
        lo = 0
        if len(text) > T:
            a = r.choice(spans)[0] if spans and r.random() < 0.8 else r.randint(0, len(text))
            lo = max(0, min(len(text) - T, a - r.randint(20, T - 20)))
            while lo and tags[lo] and tags[lo] % 2 == 0:
                lo -= 1
        c = codes(text)[lo : lo + T]
        X[: len(c), j], Y[: len(c), j], M[: len(c), j] = c, tags[lo : lo + T], 1
    return X, Y, M


def crf_grad(tg: Tagger, em: np.ndarray, Y: np.ndarray, lens: np.ndarray):
    """Mean negative log-likelihood, its gradient by emission, transition and start."""
    Tn, B, K = em.shape
    A, st = tg.p["A"], tg.p["start"]
    al = np.zeros((Tn, B, K), np.float32)
    al[0] = em[0] + st
    for t in range(1, Tn):
        s = al[t - 1][:, :, None] + A[None]
        m = s.max(1, keepdims=True)
        al[t] = np.where((t < lens)[:, None], np.log(np.exp(s - m).sum(1)) + m[:, 0] + em[t], al[t - 1])
    m = al[-1].max(1, keepdims=True)
    logz = (np.log(np.exp(al[-1] - m).sum(1)) + m[:, 0])[:, None]
    be = np.zeros((B, K), np.float32)
    dem, dA = np.zeros_like(em), np.zeros_like(A)
    for t in range(Tn - 1, -1, -1):
        live = (t < lens)[:, None]
        dem[t] = np.where(live, np.exp(al[t] + be - logz), 0)
        if t:
            x = em[t] + be
            pair = np.exp(al[t - 1][:, :, None] + A[None] + x[:, None, :] - logz[:, :, None]) * live[:, :, None]
            dA += pair.sum(0)
            s = A[None] + x[:, None, :]
            mm = s.max(2, keepdims=True)
            be = np.where(live, np.log(np.exp(s - mm).sum(2)) + mm[:, :, 0], be)
    dst = dem[0].sum(0)
    j = np.arange(B)
    nll = logz[:, 0].copy()
    for t in range(Tn):
        live = (t < lens).astype(np.float32)
        nll -= em[t, j, Y[t]] * live
        dem[t, j, Y[t]] -= live
        if t:
            nll -= A[Y[t - 1], Y[t]] * live
            np.add.at(dA, (Y[t - 1], Y[t]), -live)
    nll -= st[Y[0]]
    np.add.at(dst, Y[0], -1.0)
    return nll.mean(), dem / B, dA / B, dst / B


def lstm_back(tg: Tagger, keep: list, dh_all: np.ndarray, X: np.ndarray, d: str, g: dict) -> None:
    h = tg.h
    U = tg.p["U" + d]
    dh, dc = 0, 0
    for t, z, gates, gg, cp, c, tc, hp, m in reversed(keep):
        dht = dh_all[t] + dh
        do = dht * tc
        dct = dht * gates[:, 2 * h :] * (np.abs(c) < 1) + dc
        dct = dct * m
        di, df, dg = dct * gg, dct * cp, dct * gates[:, :h]
        dz = np.concatenate([di, df, do, dg], 1)
        lin = z[:, : 3 * h]
        dz[:, : 3 * h] *= 0.25 * (np.abs(lin) < 2)
        dz[:, 3 * h :] *= np.abs(z[:, 3 * h :]) < 1
        _scatter(g["E" + d], X[t], dz)
        g["U" + d] += hp.T @ dz
        dh, dc = dz @ U.T, dct * gates[:, h : 2 * h]


def _scatter(into: np.ndarray, idx: np.ndarray, rows: np.ndarray) -> None:
    one = np.zeros((len(into), len(idx)), np.float32)
    one[idx, np.arange(len(idx))] = 1
    into += one @ rows


def _worker(conn, seed: int, labels: str, start_lr: float) -> None:
    """Local steps from the parameters received, with moments of its own, until None comes."""
    r = random.Random(seed)
    bg, known = labelled_rows(labels)
    m1, m2, step = {}, {}, 0
    while (got := conn.recv()) is not None:
        params, steps, part = got
        tg, loss = Tagger(params), 0.0
        for _ in range(steps):
            X, Y, M = batch(r, bg, 160, known)
            lens = M.sum(0).astype(int)
            kf: list = []
            kb: list = []
            f, b = tg._run(X, M, "f", kf), tg._run(X, M, "b", kb)
            em = f @ tg.p["V"][:H] + b @ tg.p["V"][H:] + tg.p["vb"]
            nll, dem, dA, dst = crf_grad(tg, em, Y, lens)
            g = {k: np.zeros_like(v) for k, v in tg.p.items()}
            g["A"], g["start"], g["vb"] = dA, dst, dem.sum((0, 1))
            flat = dem.reshape(-1, len(TAGS))
            g["V"][:H], g["V"][H:] = f.reshape(-1, H).T @ flat, b.reshape(-1, H).T @ flat
            lstm_back(tg, kf, dem @ tg.p["V"][:H].T, X, "f", g)
            lstm_back(tg, kb, dem @ tg.p["V"][H:].T, X, "b", g)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            step += 1
            lr = start_lr * min(1, step / 30) * max(0.03, 1 - part)
            for k in tg.p:
                gk = g[k] * scale
                m1[k] = 0.9 * m1.get(k, 0) + 0.1 * gk
                m2[k] = 0.99 * m2.get(k, 0) + 0.01 * gk * gk
                tg.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss += float(nll) / steps
        conn.send((tg.p, loss))


def train(labels: str, out: str, seconds: float, start: str | None = None, workers: int = 0, steps: int = 12) -> None:
    rng = np.random.default_rng(SEED)
    K = len(TAGS)
    p = {"V": rng.normal(0, 0.1, (2 * H, K)), "vb": np.zeros(K), "A": rng.normal(0, 0.05, (K, K)), "start": np.zeros(K)}
    p["vb"][0] = 1.0
    for d in "fb":
        p["E" + d] = rng.normal(0, 0.3, (N_SYMBOLS, 4 * H))
        p["E" + d][:, H : 2 * H] += 2.0
        p["U" + d] = rng.normal(0, 0.6 / np.sqrt(H), (H, 4 * H))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if start:
        known = Tagger.load(Path(start)).p
        p = {k: known[k].copy() for k in p}
    conns, procs = [], []
    for w in range(workers or os.cpu_count() or 1):
        here, there = mp.Pipe()
        procs.append(mp.Process(target=_worker, args=(there, SEED + w, labels, 0.005 if start else 0.01), daemon=True))
        procs[-1].start()
        conns.append(here)
    began, rounds = time.time(), 0
    while (spent := time.time() - began) < seconds:
        for c in conns:
            c.send((p, steps, spent / seconds))
        got = [c.recv() for c in conns]
        p = {k: np.mean([g[0][k] for g in got], 0, dtype=np.float64).astype(np.float32) for k in p}
        rounds += 1
        if rounds % 10 == 0:
            print(f"{spent:.0f} s, round {rounds}, loss {np.mean([g[1] for g in got]):.3f}", flush=True)
    for c in conns:
        c.send(None)
    tg = Tagger(p)
    print(evaluate(tg, random.Random(99), labelled_rows(labels)[0]))
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in tg.p.items()})


def evaluate(tg: Tagger, r: random.Random, bg: list[str], n: int = 2000) -> dict:
    """Span and (text, type) scores on freshly generated labelled texts."""
    X, Y, M = batch(r, bg, n)
    lens = M.sum(0).astype(int)
    hit = got = want = t_hit = t_got = t_want = 0
    em = tg._run(X, M, "f") @ tg.p["V"][:H] + tg._run(X, M, "b") @ tg.p["V"][H:] + tg.p["vb"]
    for j, path in enumerate(tg.viterbi(em.transpose(0, 2, 1), lens)):
        a, b = set(spans_of(path)), set(spans_of(Y[: lens[j], j]))
        hit, got, want = hit + len(a & b), got + len(a), want + len(b)
        ta, tb = {x[2] for x in a}, {x[2] for x in b}
        t_hit, t_got, t_want = t_hit + len(ta & tb), t_got + len(ta), t_want + len(tb)
    return {"span_precision": round(hit / max(1, got), 4), "span_recall": round(hit / max(1, want), 4), "type_precision": round(t_hit / max(1, t_got), 4), "type_recall": round(t_hit / max(1, t_want), 4)}


if __name__ == "__main__":
    if sys.argv[1] == "label":
        label(*sys.argv[2:5])
    else:
        train(sys.argv[1], sys.argv[2], float(sys.argv[3]), sys.argv[4] if len(sys.argv) > 4 else None)
