"""Sentence boundaries across languages and scripts.

Marks are told by the character property Sentence_Break, whose classes are read from the property itself: a sentence ends
after a terminator of any script (STerm) with the closing marks behind it (Close), rules SB9 to SB11; a full stop (ATerm)
ends none before a digit (SB6), between letters (SB7) or before a lower-case word (SB8); none ends before a mark that goes
on (SContinue, SB8a). On top come abbreviations by language, quotations kept whole, and, for languages without end marks,
breaks at blanks. A number does not hide the lower-case word behind it, unlike in SB8, for sentences open with numbers,
and a dash may open one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlake.plans.spread import spread

# Abbreviations by language, lower case, without the last full stop.
# They open or stand inside a phrase and never end a sentence.
INSIDE = {
    "en": "mr mrs ms dr prof rev gen col sgt capt lt hon st rs approx viz vs cf e.g i.e fig figs nos pvt al ca est messrs jr dept",
    "de": "z.b d.h u.a mio mrd abb bzw ca evtl ggf hr fr inkl usf vgl zzgl str bd",
    "fr": "mme mlle mgr env éd fasc ste",
    "es": "sr sra srta dra ud uds aprox ee avda dña",
    "hi": "डॉ श्री प्रो",
    "ar": "د أ م",
}
# They abbreviate what a number follows and are ordinary words or ends otherwise.
BEFORE_NUMBER = {
    "en": "no sec sect vol para paras p pp reg sched art ch cl ex app ed ver v s",
    "de": "nr abs art kap tel s",
    "fr": "art l'art n chap al",
    "es": "art pág págs núm cap",
}
# Of these some are units as well, and end a sentence when a number goes before.
ALSO_UNITS = "pp p s h v tel"
# They may also end a sentence: what follows decides.
EITHER = {
    "en": "inc ltd corp co llc plc bros p.a a.m p.m cr etc u.s u.k u.n e.u d.c",
    "de": "gmbh co usw",
    "fr": "cie etc",
    "es": "cía etc s.a uu",
}
MONTHS = {
    "en": "jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "jan feb märz apr jun jul aug sept okt nov dez",
    "fr": "janv févr mars avr juill sept oct nov déc",
    "es": "ene feb mar abr jun jul ago sept oct nov dic",
}
# Nouns whose letter is a name, so that the full stop after the letter is an end mark.
LETTERED = "plan option grade class type section part phase group team annex appendix exhibit schedule unit vitamin tier series zone route platform"
# What follows a German ordinal number.
AFTER_ORDINAL = "januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr jahrhundert jahrestag auflage"
# Words that open a sentence after an abbreviation which is also used before names.
OPENERS = "the a an in on at it he she they we this that these those its his her their but and as under for with from to if when"
# Chinese verbs of saying that tie a quotation to its speaker.
SAYING = "说 表示 称 道 指出 问 写道"

_set = lambda d: frozenset(w for ws in d.values() for w in ws.split())
_INSIDE, _NUMBER, _EITHER, _MONTHS = map(_set, (INSIDE, BEFORE_NUMBER, EITHER, MONTHS))
_LETTERED, _ORDINAL, _OPENERS, _UNITS = (frozenset(x.split()) for x in (LETTERED, AFTER_ORDINAL, OPENERS, ALSO_UNITS))

#: All characters of the planes that hold marks.
_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def property_class(name: str) -> str:
    """The characters whose Sentence_Break property is ``name``."""
    return "".join(regex.findall(rf"\p{{Sentence_Break={name}}}", _EVERY))


# The class Close holds opening marks as well; straight quotation marks do both.
CLOSING = "".join(c for c in property_class("Close") if unicodedata.category(c) in ("Pe", "Pf") or c in "\"'")
GOES_ON = "".join(c for c in property_class("SContinue") if unicodedata.category(c) != "Pd") + ";；"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}
# Stops of Tibetan, which the property leaves out.
FULL = property_class("STerm").replace("!", "").replace("?", "") + "\u0f0d\u0f0e"
# Marks among them that ask or exclaim, after which a quotation's sentence may go on.
DOUBLE = "\u203c\u203d\u2047\u2048\u2049\ufe56\ufe57"
#: The full stop comes first; the others are of other widths.
STOPS = "".join(sorted(property_class("ATerm")))
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
_MARK = re.compile(rf"([{STOPS}…]+|[!?][!?{STOPS}…]*|[{FULL}]+[!?{FULL}]*)([{re.escape(CLOSING)}]*)")
_QUOTE = re.compile("[\"“„«「『‹']")
_SPACE = re.compile(r"\s*")
_TOKEN_EDGE = re.compile(r".*[\s(\[\"“„«]", re.S)
_LEAD = re.compile(r"^[^\w]*[\d.,\u2009\u202f]*\d|^[^\w]+")
_WORD = re.compile(r"[^\W\d_]+")
_SAID = re.compile(rf"[^。！？]{{0,60}}?(?:{'|'.join(SAYING.split())})[。，：！]")
_ROMAN = re.compile(r"[IVXLC]+\b")
_THAI = re.compile("[ก-๏]")
_THAI_BLANK = re.compile("(?<=[ก-๏%％)”\"])\\s+(?=[ก-๏“\"(])")
_CODE = re.compile(r"[A-Z]{3}\s+[a-z(]")


def _quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations of a block as (opening mark, place after the closing mark)."""
    found, at = [], start
    while m := _QUOTE.search(text, at, end):
        i, mark = m.start(), m.group()
        at = i + 1
        before = text[i - 1] if i > start else " "
        if mark in PAIRS:
            ends = [j for j in (text.find(c, i + 1, end) for c in PAIRS[mark]) if j >= 0]
            close = min(ends, default=-1)
        elif not (before.isspace() or before in "([—–-:") and (before.isalnum() or mark == "'"):
            continue
        elif mark == '"':
            close = text.find('"', i + 1, end)
        else:  # a single straight mark opens a quotation only before a capital and closes one only after a stop
            if not text[i + 1 : i + 2].isupper():
                continue
            close = next((j for j in (text.find(s + "'", i, end) for s in ".!?,") if j >= 0), -1)
            close += close >= 0
        if close >= 0:
            found.append((i, close + 1))
            at = close + 1
    return found


def _starts(text: str, i: int) -> bool:
    """Whether a sentence may start at ``i``: anything but a lower-case word, names such as ``eBay`` apart."""
    c = text[i]
    return not c.islower() or text[i + 1 : i + 2].isupper()


def _full_stop(text: str, start: int, dot: int, nxt: int, end: int, gap: bool) -> bool:
    """Whether the single full stop at ``dot`` ends a sentence, text going on at ``nxt``."""
    c = text[nxt]
    if not _starts(text, nxt):
        return False
    low_end = max(start, dot - 40)
    edge = _TOKEN_EDGE.match(text, low_end, dot)
    raw = text[edge.end() if edge else low_end : dot]
    token = _LEAD.sub("", raw)
    if not gap:
        if not c.isupper() and c not in "\"“«(":
            return False
        before = text[dot - 1]
        if before.isupper() and len(token) == 1 or "." in token:
            head = text[max(start, dot - 30) : dot - len(token)].split()
            return bool(head) and head[-1].lower() in _LETTERED and len(token) == 1
    low = token.lower()
    if not low:  # a number, a percentage or a symbol
        if raw.isdigit() and len(raw) <= 2 and (w := _WORD.match(text, nxt, end)):
            return w.group().lower() not in _ORDINAL
        return True
    if len(token) == 1 and token.isascii() and raw == token:
        head = text[max(start, dot - 30) : dot - 1].split()
        last = head[-1] if head else ""
        if token.isupper():
            return last.lower() in _LETTERED
        if token == "h" and last[-1:].isdigit():
            return True
        return low in _NUMBER and not c.isdigit() and len(raw) == 1 and last[-1:].isdigit()
    if low in _INSIDE:
        return False
    if low in _NUMBER and (c.isdigit() or _ROMAN.match(text, nxt, end)):
        head = text[max(start, dot - 20) : dot - len(token)].split()
        return low in _UNITS and bool(head) and head[-1][-1:].isdigit()
    if low in _MONTHS and c.isdigit():
        head = text[max(start, dot - 20) : dot - len(token)].split()
        year = re.match(r"(?:19|20)\d\d\b", text[nxt : nxt + 5])
        return not (head and head[-1].rstrip(".").isdigit() or year)
    if low in _EITHER:
        if low in ("u.s", "u.k", "u.n", "e.u", "d.c", "uu"):
            w = _WORD.match(text, nxt, end)
            return bool(w) and w.group().lower() in _OPENERS
        return not _CODE.match(text, nxt, end)
    return True


def _cuts(text: str, start: int, end: int) -> Iterator[int]:
    """Places in ``text[start:end]``, one block, after which a sentence ends."""
    quotes = _quotations(text, start, end)
    k, begun = 0, start
    for m in _MARK.finditer(text, start, end):
        mark, after = m.group(1), m.end()
        while k < len(quotes) and quotes[k][1] <= m.start():
            k += 1
        quoted = k < len(quotes) and quotes[k][0] < m.start() < quotes[k][1]
        if quoted:
            close = quotes[k][1]
            if text[m.end(1) : close - 1].strip(CLOSING + " \n\u00a0\u202f"):
                continue
            after = close
            while after < end and text[after] in CLOSING:
                after += 1
        if m.start() < begun:
            continue
        nxt = _SPACE.match(text, after, end).end()
        if nxt >= end:
            return
        c, gap = text[nxt], nxt > after
        if c in GOES_ON or c in CLOSING and not gap:
            continue
        closers = text[m.end(1) : after]
        if any(x in ")]）" for x in closers) and text[begun] not in "([（\"“'":
            continue
        if gap and c in FULL:  # a mark set off by a blank belongs to the sentence before
            continue
        if mark[0] in FULL and (not gap or mark[0] not in DOUBLE):
            if closers.strip() and not gap and ("぀" <= c <= "ゟ" or _SAID.match(text, nxt, end)):
                continue
            ok = True
        elif mark[0] in "!?" or mark[0] in DOUBLE:
            ok = _starts(text, nxt) if closers.strip() else True
            if not gap:
                ok = c.isupper() or c in "\"“«("
        elif len(mark) > 1 and not (len(mark) == 2 and mark != ".."):
            ok = gap and _starts(text, nxt)
        elif closers.strip():
            ok = _starts(text, nxt)
        elif mark[0] in STOPS[1:]:  # stops of other widths, which no blank need follow
            ok = _starts(text, nxt) and (gap or not c.isnumeric())
        else:
            ok = _full_stop(text, begun, m.start(), nxt, end, gap)
        if ok:
            yield after
            begun = nxt


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Sentences of ``text`` as (start, end) in code points, outer whitespace left out.

    A blank line ends a unit and a heading or table row between blank lines is one unit, since it holds no end mark; a
    single line break is a blank. Null, empty and blank texts have no sentence.
    """
    if not text:
        return []
    out, at, edges = [], 0, [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)]
    for stop, again in [*edges, (len(text), len(text))]:
        start = _SPACE.match(text, at, stop).end()
        end = start + len(text[start:stop].rstrip())
        at = again
        if start >= end:
            continue
        cuts = set(_cuts(text, start, end))
        if _THAI.search(text, start, end):
            quotes = _quotations(text, start, end)
            cuts |= {m.start() for m in _THAI_BLANK.finditer(text, start, end) if not any(a < m.start() < b for a, b in quotes)}
        for cut in sorted(cuts):
            out.append((start, cut))
            start = _SPACE.match(text, cut, end).end()
        out.append((start, end))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def spans(texts: pd.Series) -> pd.Series:
    """:func:`sentence_spans` of a column."""
    return texts.map(lambda t: [{"sent_start": a, "sent_end": b} for a, b in sentence_spans(t)])


def split_sentences(rows: DataFrame, key: Column, text: str, field: str, least: int = 1) -> DataFrame:
    """``(text_field, row_key, sent_start, sent_end)``: a row per sentence of every text with ``least`` sentences or more.

    * A key that occurs again is given once. Should its texts differ, the one with the smallest list of places counts.
    * Null keys and null or empty texts give no rows. Columns besides the two are ignored.

    Texts never cross a shuffle: only the places of sentences do, to drop repeated keys.
    """
    cut = spread(rows).select(key.alias("row_key"), spans(F.col(text)).alias("s")).where(F.col("row_key").isNotNull() & (F.size("s") >= least))
    once = cut.groupBy("row_key").agg(F.min("s").alias("s"))
    return once.select(F.lit(field).alias("text_field"), "row_key", F.inline("s"))
