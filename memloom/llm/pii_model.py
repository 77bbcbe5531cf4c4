"""Character-level bidirectional LSTM with a CRF on top, in numpy only.

Inference and training share the forward pass.  Gates use piecewise linear
activations (hard sigmoid, hard tanh): they cost a clip each, which is what
lets the tagger read a corpus at about a microsecond per character and core.
Padding resets the state, so a result never depends on batching.
"""

from __future__ import annotations

import unicodedata
from pathlib import Path

import numpy as np

from memloom.llm.pii_data import TYPES

MODEL = Path(__file__).with_name("models") / "pii_tagger.npz"
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
PUNCT = " \n\t.,:;-_+/()[]<>@#'\"&=*|!?%$\\{}`~^"
PAD, DIGIT, OTHER, CJK = 0, 1, 2, 3
N_SYMBOLS = 4 + len(PUNCT) + 52


def _table() -> np.ndarray:
    """Class of every code point of the basic plane: digits are one class, letters keep their case and lose their accents."""
    t = np.full(65536 + 1, OTHER, np.uint8)
    for cp in range(0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)[:1]
        if ch.isdigit():
            t[cp] = DIGIT
        elif "a" <= base <= "z":
            t[cp] = 4 + len(PUNCT) + ord(base) - 97
        elif "A" <= base <= "Z":
            t[cp] = 4 + len(PUNCT) + 26 + ord(base) - 65
    for i, ch in enumerate(PUNCT):
        t[ord(ch)] = 4 + i
    for cp in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0, 0x2007, 0x202F, 0x3000):
        t[cp] = 4  # blanks of all kinds are one symbol
    t[ord("ß")] = 4 + len(PUNCT) + 18
    t[0x2E80:0xA000] = CJK
    for cp in range(0xFF01, 0xFF5F):
        t[cp] = t[cp - 0xFEE0]
    t[ord("。")], t[ord("，")] = t[ord(".")], t[ord(",")]
    return t


CLASSES = _table()


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CLASSES[np.minimum(cp, 65536)]


class Tagger:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v for k, v in p.items()}
        self.h = self.p["Uf"].shape[0]

    @classmethod
    def load(cls, path: Path = MODEL) -> "Tagger":
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) if z[k].dtype == np.float16 else z[k] for k in z.files})

    # -- forward -------------------------------------------------------------
    def _run(self, X: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """X: symbols (T, B); returns hidden states (T, B, h) of direction d ('f' or 'b')."""
        T, B = X.shape
        h = self.h
        table, U = self.p["E" + d], self.p["U" + d]
        hs = np.zeros((T, B, h), np.float32)
        hp, cp = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = table[X[t]]
            z += hp @ U
            gates = z[:, : 3 * h] * 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            g = np.clip(z[:, 3 * h :], -1, 1)
            c = gates[:, h : 2 * h] * cp
            c += gates[:, :h] * g
            m = mask[t][:, None]
            c *= m
            tc = np.clip(c, -1, 1)
            hn = gates[:, 2 * h :] * tc
            if keep is not None:
                keep.append((t, z, gates, g, cp, c, tc, hp, m))
            hs[t] = hn
            hp, cp = hn, c
        return hs

    def _states(self, X: np.ndarray, alive: np.ndarray, d: str) -> np.ndarray:
        """The states of ``_run`` for decoding: gates apart, buffers reused. ``alive``: columns (sorted by length) that reach each step."""
        T, B = X.shape
        h = self.h
        scale = np.array([0.25, 0.25, 0.25, 1], np.float32)[:, None, None]
        shift = np.array([0.5, 0.5, 0.5, 0], np.float32)[:, None, None]
        E = np.ascontiguousarray(self.p["E" + d].reshape(-1, 4, h).transpose(1, 0, 2) * scale + shift)
        U = np.ascontiguousarray(self.p["U" + d].reshape(h, 4, h).transpose(1, 0, 2) * scale)
        hs = np.zeros((T, B, h), np.float32)
        hp, c, tmp = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32), np.empty((B, h), np.float32)
        z, m = np.empty((4, B, h), np.float32), np.empty((4, B, h), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            k = alive[t]
            x = X[t, k:]
            for g in range(4):
                np.take(E[g], x, axis=0, out=z[g, k:], mode="clip")
            zk, ck, tk = z[:, k:], c[k:], tmp[k:]
            np.matmul(hp[k:], U, out=m[:, k:])
            zk += m[:, k:]
            # one pass each: a minimum and a maximum of their own took a third of the time
            np.clip(zk[:3], 0, 1, out=zk[:3])
            np.clip(zk[3], -1, 1, out=zk[3])
            ck *= zk[1]
            np.multiply(zk[0], zk[3], out=tk)
            ck += tk
            np.clip(ck, -1, 1, out=tk)
            hp = hs[t]
            np.multiply(zk[2], tk, out=hp[k:])
        return hs

    def emissions(self, X: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(T, K, B) of symbols X whose columns are sorted by length, shortest first."""
        alive = np.searchsorted(lens, np.arange(len(X)), "right")
        X = X.astype(np.intp)
        f, b = self._states(X, alive, "f"), self._states(X, alive, "b")
        V = self.p["V"].T
        out = np.matmul(V[:, : self.h], f.transpose(0, 2, 1))
        out += np.matmul(V[:, self.h :], b.transpose(0, 2, 1))
        out += self.p["vb"][:, None]
        return out

    # -- decoding ------------------------------------------------------------
    def viterbi(self, em: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """em (T, K, B); best tag sequence of each column.  The way back is found again from the kept scores."""
        T, K, B = em.shape
        A = self.p["A"]
        scores = np.empty((T, K, B), np.float32)
        scores[0] = em[0] + self.p["start"][:, None]
        s = np.empty((K, K, B), np.float32)
        for t in range(1, T):
            np.add(scores[t - 1][:, None, :], A[:, :, None], out=s)
            s.max(0, out=scores[t])
            scores[t] += em[t]
        paths = np.zeros((T, B), np.int8)
        last = lens - 1
        tag = np.zeros(B, np.int64)
        for t in range(T - 1, -1, -1):
            ends = last == t
            best = (scores[t] + A[:, tag]).argmax(0) if not ends.all() else None
            tag = scores[t].argmax(0) if best is None else np.where(ends, scores[t].argmax(0), best) if ends.any() else best
            paths[t] = tag
        return [paths[: int(n), j] for j, n in enumerate(lens)]


def spans_of(path: np.ndarray) -> list[tuple[int, int, str]]:
    out, i, n = [], 0, len(path)
    nz = np.flatnonzero(path)
    if not len(nz):
        return out
    i = int(nz[0])
    while i < n:
        k = int(path[i])
        if k:
            j = i + 1
            inner = k + (k % 2)
            while j < n and path[j] == inner:
                j += 1
            out.append((i, j, TYPES[(k - 1) // 2]))
            i = j
        else:
            i += 1
    return out
