"""Text normalisation and segmentation: pure functions with character offsets."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Characters that become others after compatibility normalisation.
TO_BLANK = "\u00a0\u202f\u2009\u2007\t"
TO_NOTHING = "\u200b\u200c\u200d\ufeff\u00ad"
TO_APOSTROPHE, TO_QUOTE, TO_HYPHEN, TO_BREAK = "‘’‚‛", "“”„", "–—‒−", "\u2028\u2029"
_MAP = {ord(c): to for chars, to in ((TO_BLANK, " "), (TO_NOTHING, ""), (TO_APOSTROPHE, "'"), (TO_QUOTE, '"'), (TO_HYPHEN, "-"), (TO_BREAK, "\n"), ("\u2026", "...")) for c in chars}
_STEPS = [(re.compile(r"(?<=[a-z])-\n(?=[a-z])"), ""), (re.compile(" {2,}"), " "), (re.compile(r"\n{3,}"), "\n\n")]


def normalise(text: str | None) -> str | None:
    """One form for text from any producer; applying it again changes nothing. Offsets are taken after it."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text).translate(_MAP)
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    return text.strip()


# Words whose full stop ends no sentence in filings.
ABBREVIATIONS = """
mr mrs ms dr prof shri smt hon st jr sr ltd pvt inc corp co plc llp cos no nos vol art sec cl para fig figs tbl ch
rs cr approx est avg yr qtr mn bn tn jan feb mar apr jun jul aug sep sept oct nov dec e.g i.e viz etc cf vs al u.s u.k p.a w.e.f
"""
_SHORT = frozenset(ABBREVIATIONS.split())
#: Longer units are broken at soft punctuation once half this length is reached.
LONGEST = 700
NUMBER_TOKEN = re.compile(r"^[(\[]?[₹$€£]?-?[\d,]+(?:\.\d+)?\)?%?$")
_BLOCK = re.compile(r"[^\n]+(?:\n[^\n]+)*")
_STOP = re.compile(r"[.!?]['\")\]]?(?=\s)")
_LAST_WORD = re.compile(r"([A-Za-z][A-Za-z.]*)[.!?]$")
_SOFT = re.compile(r"(?<=[;:])\s|\n")


class Unit(NamedTuple):
    at: int
    to: int
    kind: str  # sentence or row


def numbers_in(text: str) -> int:
    return sum(1 for t in text.split() if NUMBER_TOKEN.match(t))


def is_row(text: str) -> bool:
    return len(text.split()) >= 2 and numbers_in(text) >= 2 and not re.search(r"[.!?]\s", text)


def _sentence_ends(text: str, at: int, to: int) -> list[int]:
    ends = []
    for m in _STOP.finditer(text, at, to):
        word = _LAST_WORD.search(text, at, m.start() + 1)
        low = word.group(1).rstrip(".").lower() if word else ""
        if not (low in _SHORT or len(low) == 1):
            ends.append(m.end())
    return [*ends, to]


def _pieces(text: str, at: int, to: int) -> list[tuple[int, int]]:
    if to - at <= LONGEST:
        return [(at, to)]
    out, start = [], at
    for m in _SOFT.finditer(text, at, to):
        if m.end() - start >= LONGEST // 2:
            out.append((start, m.end()))
            start = m.end()
    return [*out, (start, to)]


def units(page: str | None) -> list[Unit]:
    """Sentences and table rows of a page; every unit is exactly the text between its offsets."""
    out = []
    for block in _BLOCK.finditer(page or ""):
        row = is_row(block.group())
        at = block.start()
        for end in [block.end()] if row else _sentence_ends(page, block.start(), block.end()):
            for a, b in _pieces(page, at, end):
                a += len(page[a:b]) - len(page[a:b].lstrip())
                b = a + len(page[a:b].rstrip())
                if a < b:
                    out.append(Unit(a, b, "row" if row else "sentence"))
            at = end
    return out


# Capitalised words that name no subject.
NOISE = """
january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec
annual report survey prospectus chapter table figure chart box annexure annex appendix section note notes page source total net gross
other others the this our their its all per cent usd inr gdp ebitda yoy qoq fy q1 q2 q3 q4 statements consolidated standalone financial
year board directors committee group offer equity shares non particulars company companies act regulation regulations rules members
management business statement risk risks million crore lakh billion percent index contents overview summary fiscal revenue earnings
presentation quarter half results
"""
_NOISE = frozenset(NOISE.split())
_WORD = r"[A-Z][A-Za-z&.]+"
_JOIN = r"(?:\s+(?:of|and|the)\s+|\s+)?"
_NAME = re.compile(rf"\b({_WORD}{_JOIN}(?:{_WORD})?{_JOIN}(?:{_WORD})?)\b")
_ENTITY = re.compile(r"\b([A-Z][A-Za-z&.\-]*(?:\s+[A-Z][A-Za-z&.\-]*){0,3})\s+(?:Limited|Ltd\.?|Inc\.?|Incorporated|Corporation|Corp\.?|PLC|LLP|LLC)\b")
_ROMAN = re.compile(r"^[IVXLCivxlc]+\.?$")
_LEGAL = re.compile(r"\b(limited|ltd|pvt|private|inc|incorporated|corp|corporation|plc|llp|llc|company|co)\b\.?", re.I)
#: Weights of a name in the title, before a legal suffix, on the first pages and elsewhere.
TITLE, LEGAL, COVER, BODY, COVERS = 8, 6, 3, 1, 3


def subject_key(name: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", _LEGAL.sub("", name)).lower().split())


def _names(text: str) -> list[str]:
    out = []
    for m in _NAME.finditer(text):
        words = m.group(1).split()
        while words and words[-1] in ("of", "and", "the"):
            words.pop()
        low = [w.lower() for w in words]
        dull = all(w in _NOISE for w in low) or len(words) == 1 and len(words[0]) < 3
        shouted = all(w.isupper() for w in words) and any(len(w) >= 5 for w in words)
        name = " ".join(words)
        if words and not dull and not shouted and not any(map(_ROMAN.match, words)) and subject_key(name):
            out.append(name)
    return out


def subject_votes(text: str | None, page_no: int) -> dict[str, int]:
    """Names in one text and their votes for the subject of its document; page 0 is the title."""
    votes: dict[str, int] = {}
    if not text:
        return votes
    weight = TITLE if page_no == 0 else COVER if page_no <= COVERS else BODY
    for name in _names(text):
        votes[name] = votes.get(name, 0) + weight
    if page_no:
        for m in _ENTITY.finditer(text):
            words = m.group(1).split()[-3:]
            if not all(w.lower() in _NOISE for w in words):
                name = " ".join(words)
                votes[name] = votes.get(name, 0) + LEGAL
    return votes
