"""Words that many cues share are added as one vector; a phrase stands for its words, each once."""

import random

import numpy as np
import pyarrow as pa

from memloom.operators import counts


def test_phrases_stand_for_their_words():
    # a vector for every frequent word of every cue took the time at size
    rng = random.Random(2)
    sentences = [rng.sample(range(40), 8) for _ in range(6)]
    cues = [sorted({*rng.choice(sentences), *rng.choice(sentences), 100 + i}) for i in range(300)]
    short, phrases = counts._phrases(cues, np.arange(40), 1000)
    parts = dict(phrases)
    words = lambda u: [x for p in parts[u] for x in words(p)] if u in parts else [u]
    assert [sorted(x for u in ws for x in words(u)) for ws in short] == cues
    assert sum(map(len, short)) < 0.6 * sum(map(len, cues))
    assert counts._phrases([[], [3]], np.zeros(0, np.int64), 9) == ([[], [3]], [])


def test_phrases_of_wide_values():
    t = pa.table({"ws": [[1, 2, 3], [1, 2], [2, 3, 3]], "id": ["a", "b", "c"], "agent": [0, 0, 0]})
    b = counts._Block({c: v[0] for c, v in counts._postings(t).to_pydict().items()}, np.array([1, 2, 3]))
    got = b.vectors(lambda u: np.full(len(b.rows[u]), 40_000, np.uint32), np.uint16, [(3, [0, 1]), (4, [3, 2])])
    assert got[3].tolist() == [80_000, 80_000, 40_000] and got[4].tolist() == [120_000, 80_000, 80_000] and got[0].dtype == np.uint16
