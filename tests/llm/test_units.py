"""Plain units of the training-data operators, without Spark."""

import random
from collections import Counter
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heldout_pii import TEXTS
from memloom.llm import pii, pii_data, pii_model, pii_train
from memloom.llm.leakage import ItemWords, stretches, words as leak_words
from memloom.llm.mixing import largest_total, route
from memloom.llm.spam import measures
from memloom.llm.split import split
from memloom.llm.textnorm import canonical, same
from memloom.llm.truncation import ending, lengths
from memloom.llm.textnorm import plain


# -- splitting -------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n。中é́xyz", max_size=400), st.integers(1, 90), st.integers(0, 100))
def test_split_invariants(text, most, overlap):
    p = split(text, most, overlap)
    o = min(overlap, most - 1)
    assert p[0][0] == p[0][1] == 0 and p[-1][2] == len(text)
    for (_, _, e), (a, b, f) in zip(p, p[1:]):
        assert b == e and a == max(0, b - o) and f > b
    assert all(e - a <= most for a, _, e in p) or len(text) <= most


def test_split_cuts_at_boundaries():
    text = "\n\n".join(" ".join(["Some words make one sentence."] * 3) for _ in range(6))
    assert all(text[e - 1] in "\n. " for _, _, e in split(text, 200, 20)[:-1])
    assert len(split("x" * 1000, 100, 10)) == 12
    assert split("", 10, 2) == [(0, 0, 0)]
    with pytest.raises(ValueError):
        split("abc", 0, 0)


def test_split_prefers_stronger_boundaries():
    text = "Aaaa bbbb cccc. Dddd eeee.\n\nFfff gggg hhhh. Iiii jjjj."
    assert [text[b:e] for _, b, e in split(text, 30, 0)] == ["Aaaa bbbb cccc. Dddd eeee.\n\n", "Ffff gggg hhhh. Iiii jjjj."]


def test_split_of_a_very_long_text():
    text = "word " * 400_000
    p = split(text, 1000, 50)
    assert max(e - a for a, _, e in p) <= 1000 and p[-1][2] == len(text)


# -- saying the same ----------------------------------------------------------------
BASE = "job 416983447 - The quiet agent roster and the access policy share one lock, so counts disagreed between views because a retry loop hid the first error."


@pytest.mark.parametrize(
    "other",
    [
        BASE.upper(), f"<div>{BASE}</div>", BASE.replace(" ", " \t"), f">> {BASE}", f"fwd: {BASE} (resent)", BASE.replace("because", "since"), BASE.replace("counts", "conuts").replace("roster", "rostter"),
        BASE.replace("the access", "by the way the access apparently"), BASE.replace("agent", "ag­ent"), BASE.translate({ord("a"): "а"}), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in BASE),
        BASE.replace(" ", "&nbsp;"), f"{BASE}\n\n-- sent from the hub",
    ],
)
def test_same(other):
    assert same(canonical(BASE), canonical(other))


@pytest.mark.parametrize("a,b", [("416983447", "416983448"), ("share", "never share"), ("because", "although"), ("counts disagreed", "counts hardly disagreed"), ("first error", "last error"), ("quiet agent roster and the access policy share", "sleep cycle and the wallet ledger held")])
def test_different(a, b):
    assert not same(canonical(BASE), canonical(BASE.replace(a, b)))


def test_canonical_of_odd_texts():
    assert canonical("") == [] and canonical("​ \n") == [] and canonical("重试80次") == sorted(["重", "试", "80", "次"])
    assert len(canonical("wort " * 100_000)) == 100_000


# -- truncation -----------------------------------------------------------------------
def test_lengths():
    n, u8, u16, ent, ent8, js, ja, j8, crlf, _ = lengths('é<"\n😀')
    assert (n, u8, u16, crlf) == (5, 9, 6, 6) and ent == n + 3 + 5 and js == n + 2 and ja == 6 + 1 + 2 + 2 + 12


@pytest.mark.parametrize("text,certain", [('{"a": "b", "c": "d', True), ("It went well [truncated]", True), ("All is well.", False), ("see (case 12", True), ("and so it goes,", True), ('{"a": 1}', False), ("ends with a broken char �", True), ("", False)])
def test_endings(text, certain):
    assert ending(text or " ", plain(text))[2] is certain


# -- leaks ------------------------------------------------------------------------------
def brute_lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return int(d[-1, -1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=40), st.lists(st.sampled_from("abcdefgh"), max_size=60))
def test_lcs(a, b):
    assert ItemWords(a).lcs(b) == brute_lcs(a, b)


def test_stretches():
    rng = random.Random(3)
    item = [rng.choice(string.ascii_lowercase) + rng.choice(string.ascii_lowercase) + str(i) for i in range(60)]
    noise = [f"n{i}" for i in range(300)]
    m = ItemWords(item)
    assert stretches(m, noise + item + noise) == 60
    assert stretches(m, noise[:50] + item[:20] + noise[50:120] + item[35:50] + noise[120:]) == 35
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    assert stretches(m, noise + changed + noise) >= 0.8 * 60
    assert stretches(m, noise) == 0 and stretches(m, []) == 0
    assert leak_words("Foo <b>bar</b> exam-\n ple &amp; x") == ["foo", "bar", "example", "x"] and leak_words(None) == []


# -- mixing ---------------------------------------------------------------------------------
def test_flow_meets_quotas_and_repeats_last():
    pats = {("a",): 1000, ("a", "b"): 500, ("b",): 100}
    targets = {"a": (0.5, 1), "b": (0.5, 2)}
    total = largest_total(pats, targets)
    got, flow = route(pats, targets, total)
    assert total == pytest.approx(2200, abs=60) or got >= total - 2
    assert flow["a", "b"] if False else flow[("a", "b"), "a"] + flow[("a", "b"), "b"] <= 2 * 500
    small, few = route(pats, targets, 800)
    assert small == 800 and few[("b",), "b"] + few[("a", "b"), "b"] == 400 and few[("a",), "a"] >= 300


def test_flow_reports_what_cannot_be_met():
    got, flow = route({("a",): 10}, {"a": (1.0, 2)}, 100)
    assert got == 20 == flow[("a",), "a"]


# -- spam ---------------------------------------------------------------------------------------
def test_measures():
    m = measures("[sync tool](https://x.test/1)\n" * 20)
    assert m[5] > 0.9 and m[1] > 50
    assert measures(None)[1] == measures("")[1] == measures(" \n")[1] == 0
    assert measures("The night planner saw that the queue was full and the disk had no room.")[8] > 0.35


# -- personal information ------------------------------------------------------------------------
def test_redaction_keeps_the_rest():
    t = "Reply goes to anna.berg@example.org before noon."
    spans = pii.find_spans(pii_model.Tagger.load(), [t, "", "Nothing here."])
    assert pii.redact(t, spans[0]) == "Reply goes to [EMAIL] before noon." and spans[1] == spans[2] == []


def test_windows_cover_and_overlap():
    w = pii.windows(5000)
    assert w[0][0] == 0 and w[-1][1] == 5000 and all(b - a <= pii.WINDOW for a, b in w) and all(x[1] - y[0] == 2 * pii.CONTEXT for x, y in zip(w, w[1:]))
    assert pii.windows(0) == [] and pii.windows(100) == [(0, 100)]


def test_long_texts_and_batches_change_nothing():
    tg = pii_model.Tagger.load()
    s = "Please reach Maria Becker under 030 23125 881 or m.becker@post.example. The disk was full and nobody saw it. "
    one = pii.find_spans(tg, [s])[0]
    long = pii.find_spans(tg, [s * 40, s, ""])
    assert long[1] == one and long[2] == [] and len(one) == 3
    assert [(a - len(s) * k, b - len(s) * k, t) for k in range(1, 39) for a, b, t in long[0] if len(s) * k <= a < len(s) * (k + 1)] == one * 38


def test_decoding_states_equal_training_states():
    tg, rng = pii_model.Tagger.load(), np.random.default_rng(3)
    n = np.array([3, 7, 9])
    X = rng.integers(1, pii_model.N_SYMBOLS, (9, 3)).astype(np.uint8)
    M = (np.arange(9)[:, None] < n).astype(np.float32)
    X[M == 0] = 0
    h = tg.h
    want = tg._run(X, M, "f") @ tg.p["V"][:h] + tg._run(X, M, "b") @ tg.p["V"][h:] + tg.p["vb"]
    got = tg.emissions(X, n).transpose(0, 2, 1)
    assert np.allclose(want[M > 0], got[M > 0], atol=1e-3)


def test_viterbi_against_all_paths():
    from itertools import product

    rng, K = np.random.default_rng(5), len(pii_model.TAGS)
    p = {"Uf": np.zeros((1, 4)), "A": rng.normal(size=(K, K)).astype(np.float32), "start": rng.normal(size=K).astype(np.float32)}
    em, n = rng.normal(size=(3, K, 2)).astype(np.float32), np.array([2, 3])
    for j, path in enumerate(pii_model.Tagger(p).viterbi(em, n)):
        score = lambda y: p["start"][y[0]] + em[0, y[0], j] + sum(p["A"][y[t - 1], y[t]] + em[t, y[t], j] for t in range(1, n[j]))  # noqa: B023, E731
        assert tuple(path) == max(product(range(K), repeat=int(n[j])), key=score)


def _scores(found, wanted):
    hit, got, want = Counter(), Counter(), Counter()
    for a, b in zip(found, wanted):
        hit.update(a & b), got.update(a), want.update(b)
    return {k: (hit[k] / max(1, want[k]), hit[k] / max(1, got[k])) for k in pii_data.TYPES}


def test_tagger_on_hand_written_sentences():
    found = pii.find_spans(pii_model.Tagger.load(), [t for t, _ in TEXTS])
    s = _scores([{k for *_, k in x} for x in found], [set(k.split()) for _, k in TEXTS])
    assert all(r >= 0.85 and p >= 0.85 for k, (r, p) in s.items() if k != "person_name")
    # names are the hardest type: the README states this figure
    assert s["person_name"][0] >= 0.7 and s["person_name"][1] >= 0.8


def test_tagger_on_generated_texts():
    rng = random.Random(20_000)
    carriers = ["The review of the stage counter ended with a plan to rotate the keys. Nobody expected that counts disagreed between views."]
    texts, spans = zip(*(pii_data.labelled_text(rng, rng.choice(carriers)) for _ in range(400)))
    s = _scores([{k for *_, k in x} for x in pii.find_spans(pii_model.Tagger.load(), list(texts))], [{k for *_, k in x} for x in spans])
    assert all(r > 0.9 and p > 0.9 for r, p in s.values())


def test_crf_gradient():
    rng = np.random.default_rng(1)
    K, h = len(pii_model.TAGS), 3
    p = {"V": rng.normal(size=(2 * h, K)), "vb": np.zeros(K), "A": rng.normal(size=(K, K)), "start": rng.normal(size=K)}
    for d in "fb":
        p["E" + d], p["U" + d] = rng.normal(size=(pii_model.N_SYMBOLS, 4 * h)), rng.normal(size=(h, 4 * h))
    tg = pii_model.Tagger({k: v.astype(np.float64) for k, v in p.items()})
    em = rng.normal(size=(5, 2, K))
    Y, lens = rng.integers(0, K, (5, 2)), np.array([5, 3])
    loss, dem, dA, _ = pii_train.crf_grad(tg, em.astype(np.float64), Y, lens)
    e = 1e-3
    for t, b, k in ((0, 0, 2), (2, 1, 4), (4, 0, 1)):
        up = em.copy()
        up[t, b, k] += e
        assert (pii_train.crf_grad(tg, up, Y, lens)[0] - loss) / e == pytest.approx(dem[t, b, k], abs=2e-2)


def test_decoding_clips_in_one_pass(monkeypatch):
    # two passes for each bound took the tagger over its CPU seconds
    tg, calls = pii_model.Tagger.load(), []
    clip = np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **k: calls.append(a) or clip(*a, **k))
    monkeypatch.setattr(np, "maximum", lambda *a, **k: pytest.fail("a pass of its own"))
    assert tg.emissions(np.ones((4, 2), np.uint8), np.array([4, 4])).shape == (4, len(pii_model.TAGS), 2)
    assert len(calls) == 2 * 4 * 3
