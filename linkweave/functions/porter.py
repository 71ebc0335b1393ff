"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

# The algorithm's suffix tables of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for k, c in enumerate(w):
        out.append(c not in "aeiou" and not (c == "y" and k > 0 and out[-1]))
    return out


def _measure(w: str) -> int:
    """The number of vowel-consonant sequences."""
    c = _consonants(w)
    return sum(1 for a, b in zip(c, c[1:], strict=False) if not a and b)


def _vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short_end(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-3:] == [True, False, True] and w[-1] not in "wxy"


def _replace(w: str, table: dict[str, str]) -> str:
    for s in sorted(table, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            return stem + table[s] if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """The stem of a word of more than two letters; others stay. Upper-case letters count as consonants."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if _vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2)
    w = _replace(w, STEP3)
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
