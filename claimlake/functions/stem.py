"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, Program 14, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes of steps 2, 3 and 4 of the paper.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_PAIRS2, _PAIRS3 = (sorted(((s, "" if t == "-" else t) for s, t in zip(x[::2], x[1::2])), key=lambda p: -len(p[0])) for x in (STEP2, STEP3))
_LONG4 = sorted(STEP4, key=len, reverse=True)


def _shape(stem: str) -> str:
    """``stem`` as c and v for consonants and vowels; y after a consonant is a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, pairs: list[tuple[str, str]]) -> str:
    for suffix, to in pairs:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            return head + to if _measure(head) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters and words of other scripts stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(head := word[: -len(suffix)]):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _PAIRS2), _PAIRS3)
    for suffix in _LONG4:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
