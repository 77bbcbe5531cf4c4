"""Canonical words of a text and the test whether two texts say the same.

Two texts say the same when they differ only in spelling, wrapping, case,
markup, filler words, close synonyms, sentence order or a few typing errors.
A different number, identifier, negation or word of opposite meaning makes
them different.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--)>", re.S)
INVISIBLE = re.compile("[­​-‏⁠⁡⁢⁣﻿᠎‪-‮]")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
CJK_RUN = re.compile(r"[⺀-鿿가-힯]")

#: Cyrillic and Greek letters that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХаеорсухіјѕԁһӏґΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
    "ABEKMHOPCTYXaeopcyxijsdhlrABEZHIKMNOPTYXo",
)

#: Wrappers that forwarding tools put around a text (fixed values).
PREFIX = re.compile(r"\s*(?:>+\s*|fwd?:\s*|re:\s*|aw:\s*|wg:\s*|note to self:\s*|\[(?:replay|resent|fwd)\]\s*)+", re.I)
SUFFIX = re.compile(r"(?:\s*\(resent\)|\s*-- ?sent from [^\n]{1,40})+\s*$", re.I)

#: Words that add nothing (fixed values, by language).
FILLERS = {
    "just", "again", "apparently", "really", "then", "also", "basically", "simply", "actually",
    "eben", "wieder", "offenbar", "halt", "nochmals",
    "ya",
    "donc", "encore", "apparemment",
    "fwd", "resent", "replay", "re",
}
FILLER_PHRASES = re.compile(r"\b(?:by the way|as noted|note to self|sent from the hub|otra vez|al parecer|(?:il )?semble t il|wie gesagt|por cierto|au fait)\b")

#: Close synonyms, each mapped to one form (fixed values).
SYNONYMS = {
    "since": "because", "decided": "agreed", "required": "needed", "saw": "noticed", "enclosed": "attached", "requested": "asked", "foresaw": "expected",
    "soon": "shortly", "shifted": "moved", "displays": "shows", "proposed": "suggested", "da": "weil", "denn": "weil", "puisque": "parce", "pues": "porque",
}
TWO_WORDS = re.compile(r"\b(?:a further|any time)\b")

#: Words that turn a statement around (fixed values, by language).
NEGATIONS = set(
    "not no never none nothing nobody neither nor hardly barely scarcely without cannot can't don't doesn't didn't isn't wasn't won't wouldn't shouldn't couldn't aren't weren't "
    "nicht kein keine keinen keiner keinem nie niemals nichts kaum ohne no nunca nada nadie sin apenas ni ne pas jamais rien aucun aucune sans guère 不 没 未 无 非 别".split()
)
#: Pairs of opposite words (fixed values).
OPPOSITES = [
    p.split("/")
    for p in (
        "true/false|before/after|early/late|earlier/later|more/less|most/least|above/below|over/under|up/down|fell/rose|fall/rise|with/without|older/newer|oldest/newest|first/last|open/closed|opened/closed|"
        "fast/slow|faster/slower|enabled/disabled|enable/disable|accept/reject|accepted/rejected|succeeded/failed|success/failure|pass/fail|passed/failed|increase/decrease|increased/decreased|always/never|all/none|"
        "start/stop|started/stopped|because/although|since/although|weil/obwohl|porque/aunque|parce/bien|safe/unsafe|reliable/unreliable|verified/unverified|owned/unowned|used/unused|likely/unlikely|"
        "high/low|higher/lower|large/small|larger/smaller|new/old|left/right|in/out|on/off|inside/outside|yes/no|can/cannot|allow/deny|allowed/denied|add/remove|added/removed|long/short|doubled/halved|"
        "gained/lost|kept/dropped|vor/nach|mehr/weniger|immer/nie|antes/después|más/menos|siempre/nunca|avant/après|plus/moins|toujours/jamais|之前/之后|clean/dirty|quiet/noisy|legacy/new|temporary/permanent|"
        "raise/lower|warm/cool|lock/unlock|holds/lacks|joined/left|recovered/crashed|public/private|full/empty|quick/slow|stable/unstable|grew/shrank|climbed/dropped"
    ).split("|")
]
POLAR = NEGATIONS | {w for p in OPPOSITES for w in p}


def plain(text: str) -> str:
    """Text without markup, entities, invisible marks, look-alike letters, wrappers and case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).replace("ʼ", "'").replace("’", "'")
        if re.search("[Ͱ-ԯ]", text) and re.search("[A-Za-z]", text):
            text = text.translate(LOOKALIKES)
    m = PREFIX.match(text)
    if m:
        text = text[m.end() :]
    tail = text[-120:]
    m = SUFFIX.search(tail) if "sent" in tail.lower() else None
    if m:
        text = text[: len(text) - len(tail) + m.start()]
    return text.lower()


def words(text: str) -> list[str]:
    """Words of the plain text; every CJK character is a word."""
    t = plain(text)
    return WORD.findall(t if t.isascii() else CJK_RUN.sub(r" \g<0> ", t))


def canonical(text: str) -> list[str]:
    """Sorted canonical words: synonyms mapped, filler words and phrases left out."""
    t = FILLER_PHRASES.sub(" ", " ".join(words(text)))
    if "a further" in t or "any time" in t:
        t = TWO_WORDS.sub(lambda m: "another" if m[0] == "a further" else "whenever", t)
    return sorted(SYNONYMS.get(x, x) for x in t.split() if x not in FILLERS)


def has_digit(w: str) -> bool:
    return any(c.isdigit() for c in w)


def number_words(ws: list[str]) -> list[str]:
    """Words that hold a digit; two texts that say the same share all of them."""
    return [w for w in ws if has_digit(w)]


def typo(a: str, b: str) -> bool:
    """One inserted, dropped, changed or swapped letter; two in words of eight or more."""
    la, lb = len(a), len(b)
    most = 2 if min(la, lb) >= 8 else 1
    if abs(la - lb) > most or min(la, lb) < 2 or has_digit(a) or has_digit(b):
        return False
    if (pa := a in POLAR) + (pb := b in POLAR) == 2 or (pa or pb) and min(la, lb) < 4:
        return False
    prev2, prev = None, list(range(lb + 1))
    for i in range(1, la + 1):
        cur = [i] + [0] * lb
        for j in range(1, lb + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cur[j] = min(cur[j], prev2[j - 2] + 1)
        prev2, prev = prev, cur
    return prev[-1] <= most


def broken_filler(w: str) -> bool:
    return any(typo(w, f) for f in ("apparently", "again", "offenbar", "wieder", "noted", "just", "encore", "parecer")) if len(w) > 3 else w in ("by", "the", "way", "as", "noted", "to", "self")


#: Largest share of the shorter text's words that light rewording touches; a fifth, so that four fifths overlap.
SLACK = 0.2


def same(a: list[str], b: list[str], slack: float = SLACK) -> bool:
    """Whether canonical word lists ``a`` and ``b`` say the same.

    What is left after equal words cancel must pair up as typing errors or be
    filler; at most ``slack`` of the shorter text may differ at all, words with
    digits, negations and opposites must be equal on both sides, and at most
    two words (a twentieth of a long text) may be left unpaired.
    """
    if a == b:
        return True
    ca, cb = Counter(a), Counter(b)
    ra, rb = list((ca - cb).elements()), list((cb - ca).elements())
    shorter = min(len(a), len(b))
    if min(len(ra), len(rb)) > max(4, slack * shorter) or max(len(ra), len(rb)) > max(6, 2 * slack * shorter):
        return False
    if any(has_digit(w) or CJK_RUN.match(w) for w in ra + rb):
        return False
    left_a = []
    for w in ra:
        k = next((k for k, x in enumerate(rb) if typo(w, x)), None)
        if k is None:
            left_a.append(w)
        else:
            rb.pop(k)
    if any(w in POLAR for w in left_a + rb):
        return False
    left_a = [w for w in left_a if not broken_filler(w)]
    left_b = [w for w in rb if not broken_filler(w)]
    if left_a and left_b:
        return len(left_a) + len(left_b) <= max(2, shorter // 20)
    return len(left_a) + len(left_b) <= max(1, shorter // 20)
