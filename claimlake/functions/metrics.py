"""Metric phrases: which words around a value name what it measures."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

# Words between a metric and its value.
LINKING = frozenset("""
stood stands standing stand was were is are be been being has have had at to by of on in into for during with from up down about
around over under approximately nearly roughly than as against versus vs reached reaching totalled totaled totalling totaling amounted
amounting registering registered recording recorded posting posted reporting came remained remaining stayed hit touched clocked
delivered achieved generated printed marked estimated projected expected forecast seen placed put exceeded crossed surpassed implied
implying including compared comparing relative vis-a-vis alongside respectively only just also further some well still mostly largely
broadly generally relatively marginally slightly significantly substantially sharply modestly steadily gradually meanwhile overall
modest strong robust healthy sharp steep notable moderate stable ample sizeable considerable muted subdued elevated benign buoyant
resilient comfortable adequate now then there here it its
""".split())  # fmt: skip
# Words that turn a level into a rate of change.
GROWTH = frozenset("""
grew grow grows growing growth rose rise rises rising increased increase increases increasing declined decline declines declining fell
fall falls falling dropped drop expanded expand expanding contracted contract contracting moderated moderate moderating accelerated
decelerated improved eased easing reduction surged jumped slowed
""".split())  # fmt: skip
# Nouns of derived measures, which name nothing alone.
DERIVED = frozenset("growth increase decrease decline rise fall drop reduction change margin share ratio rate contribution level value".split())
# Words that may stand inside a noun phrase but neither open nor close it.
INSIDE = frozenset("of from in on for to and & per by the a".split())
# Words at which a noun phrase has ended.
ENDING = frozenset("""
the a an our its their his her this that these those which who while whereas although though because if when after before however
thereby we they company such namely etc e.g i.e viz including cent percent percentage crore lakh million billion
""".split())  # fmt: skip
LONGEST = 7

_TOKEN = re.compile(r"[A-Za-z][A-Za-z.'’&-]*|[^\sA-Za-z]")
_OWNER = re.compile(r"(.+)['’]s$")


class Phrase(NamedTuple):
    text: str
    rate: bool = False
    owner: str | None = None


class Word(NamedTuple):
    text: str
    low: str
    kind: str  # value, taken, mark, owner, growth, linking, ending, plain


def _read(text: str, at: int, to: int, taken: list[tuple[int, int]], values: list[tuple[int, int]]) -> list[Word]:
    """Words of ``text`` that lie wholly within ``at`` and ``to``, each with the part it can play."""
    out = []
    for m in _TOKEN.finditer(text, at, to):
        word, low, span = m.group(), m.group().lower(), m.span()
        inside = lambda spans: any(span[0] < e and s < span[1] for s, e in spans)  # noqa: E731, B023
        if inside(values):
            kind = "value"
        elif inside(taken):
            kind = "taken"
        elif not any(c.isalnum() for c in word):
            kind = "mark"
        elif _OWNER.match(word):
            kind = "owner"
        elif low in GROWTH:
            kind = "growth"
        elif low in ENDING:
            kind = "ending"
        else:
            kind = "linking" if low in LINKING else "plain"
        out.append(Word(word, low, kind))
    return out


def trim(words: Iterable[str]) -> str:
    """Words joined, without final stops and without inner words at either end."""
    kept = [w for w in (w.rstrip(".") for w in words) if w]
    while kept and kept[0].lower() in INSIDE:
        del kept[0]
    while kept and kept[-1].lower() in INSIDE:
        del kept[-1]
    return " ".join(kept)


def before(text: str, at: int, taken: list[tuple[int, int]], topic: str | None = None, values: list[tuple[int, int]] = ()) -> Phrase:
    """The phrase before a value at ``at``, read from right to left.

    Other values are passed until the phrase has begun and end it afterwards. A growth word makes the value a rate
    unless it is reached by way of "to" or beyond another value. A phrase of nothing but a derived noun goes on looking
    for what it derives from; ``topic``, the sentence's first metric, helps where it finds nothing.
    """
    phrase: list[str] = []
    rate, passed, behind, owner = False, False, "", None
    for w in reversed(_read(text, 0, at, taken, values)):
        if w.kind == "taken":
            continue
        if phrase and w.kind in ("value", "mark", "owner"):
            owner = _OWNER.match(w.text).group(1) if w.kind == "owner" else None
            break
        if w.kind == "growth":
            rate = behind != "to" and not passed
            if phrase:
                break
            if w.low in DERIVED:
                phrase.append(w.text)
                continue
        elif w.kind == "value":
            passed = True
            continue
        elif w.kind == "owner":
            continue
        elif w.kind == "plain" or w.kind == "linking" and phrase and w.low in INSIDE:
            phrase.append(w.text)
            if len(phrase) >= LONGEST:
                break
            if len(phrase) > 1:
                continue
        elif phrase and not all(p.lower() in DERIVED for p in phrase):
            break
        behind = w.low
    said = trim(reversed(phrase))
    if topic and said.lower() in DERIVED:
        said = f"{topic} {said}"
    if rate and said and DERIVED.isdisjoint(said.lower().split()):
        said += " growth"
    return Phrase(said, rate, owner)


def after(text: str, at: int, taken: list[tuple[int, int]], values: list[tuple[int, int]] = ()) -> Phrase:
    """The phrase behind a value that ends at ``at``."""
    phrase: list[str] = []
    for w in _read(text, at, len(text), taken, values):
        if w.kind == "taken":
            continue
        open_class = w.low in LINKING or w.low in ENDING
        if w.kind in ("value", "mark") or open_class and not phrase:
            if phrase:
                break
            continue
        if w.low in ENDING or w.low in LINKING and w.low not in INSIDE:
            break
        phrase.append(w.text)
        if len(phrase) >= LONGEST:
            break
    return Phrase(trim(phrase))


def governing(text: str, at: int, to: int, unit: str, taken: list[tuple[int, int]], topic: str | None, values: list[tuple[int, int]]) -> Phrase:
    """The phrase on the side that names the metric: counts, weights and days stand before what they count."""
    left = before(text, at, taken, topic, values)
    if unit in ("count", "tonne", "day"):
        right = after(text, to, taken, values)
        if right.text and len(right.text) >= len(left.text) // 2:
            return right._replace(rate=left.rate, owner=left.owner)
    return left


def metric_key(phrase: str) -> str:
    """The form under which phrases of different documents meet."""
    words = (w.strip(".,;:()[]'\"") for w in phrase.lower().split())
    words = (w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words)
    return " ".join(w for w in words if w and w not in INSIDE)
