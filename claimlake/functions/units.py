"""Quantities as written, in common units: pure functions from text to exact integers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Base units whose values are kept whole; all others are kept in thousandths.
WHOLE = ("INR", "USD", "EUR", "GBP", "count")
BASE_UNITS = (*WHOLE, "percent", "percentage_point", "tonne", "ratio", "day")
# Each written unit with its base unit, and one of it in the kept measure as numerator and denominator.
UNITS = {
    ("INR", 1, 1): "₹ rs rs. inr re. रुपये रुपए रु रु. rupees rupee",
    ("USD", 1, 1): "us$ usd $ us-dollar us-dollars dollar dollars dólares dólar ドル 美元 ดอลลาร์ دولار",
    ("EUR", 1, 1): "€ eur euro euros d'euros ユーロ 欧元 ยูโร يورو",
    ("GBP", 1, 1): "£ gbp pound pounds",
    ("percent", 1000, 1): "% percent per_cent pc pct por_ciento prozent pour_cent प्रतिशत パーセント เปอร์เซ็นต์ في_المئة",
    ("percent", 10, 1): "bps bp basis_point basis_points",
    ("percentage_point", 1000, 1): "percentage_point percentage_points pp ppt pct_point pct_points %-pt",
    ("tonne", 1000, 1): "mt t ton tons tonne tonnes metric_ton metric_tons",
    ("tonne", 1_000_000, 1): "kt kilotonne kilotonnes",
    ("tonne", 1, 1): "kg kgs kilogram kilograms",
    ("tonne", 100, 1): "quintal quintals qtl q",
    ("ratio", 1000, 1): "x times",
    ("day", 1000, 1): "day days d",
    ("day", 7000, 1): "week weeks wk wks",
    ("day", 1000, 24): "hour hours hr hrs h",
    ("count", 1, 1): "count nos nos. number unit units parcels stück envíos d'unités unités पार्सल طرد ชิ้น 件 個 个",
}
# Each written scale with its factor.
SCALES = {
    1_000: "thousand k '000 000s हज़ार mil tausend mille ألف",
    10_000: "万 萬 ten_thousand",
    100_000: "lakh lakhs lac lacs लाख",
    1_000_000: "million millions mn mm m mio mio. millones millón ล้าน مليون",
    10_000_000: "crore crores cr cr. करोड़",
    100_000_000: "亿 億",
    1_000_000_000: "billion billions bn mrd mrd. milliard milliards مليار mil_millones",
    1_000_000_000_000: "trillion trillions tn trn lakh_crore lakh_crores lakh_cr lakh_cr. 兆",
}
#: Words around a unit in a declaration that mean nothing.
FILLER = "in of the figures all amounts de d"


def _form(word: str) -> str:
    return unicodedata.normalize("NFKC", word.replace("_", " ").replace("क़", "क़")).lower()


_WORDS = {_form(w): ("unit", u) for u, ws in UNITS.items() for w in ws.split()} | {_form(w): ("scale", s) for s, ws in SCALES.items() for w in ws.split()} | {w: ("filler", None) for w in FILLER.split()}
_NEXT = re.compile("|".join(re.escape(w) for w in sorted(_WORDS, key=len, reverse=True)))
_BARE_LATIN = re.compile(r"[a-zà-ÿ]")
# Words that tell of a decimal comma.
_CONTINENTAL = re.compile(r"prozent|mio|mrd|stück|us-dollar|pour cent|por ciento|million?es|millions? d|milliards|m€|envíos|dólares|de usd")
_NUMBER = re.compile(r"\d(?:[\d.,'٫٬]|[ ](?=\d{3}(?!\d)))*")
_DIGITS = {ord(c): str(unicodedata.digit(c)) for c in "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९๐๑๒๓๔๕๖๗๘๙"}


class Measure(NamedTuple):
    """A written quantity: ``mantissa / 10**decimals * scale`` of ``unit`` (None where none is written)."""

    mantissa: int
    decimals: int
    scale: int
    scaled: bool
    unit: tuple[str, int, int] | None


@lru_cache(maxsize=20_000)
def read_words(text: str) -> tuple[tuple[str, int, int] | None, int, bool, bool]:
    """Unit, scale, whether a scale is written, and whether all of ``text`` (already in normal form) was understood."""
    unit, scale, scaled, clean, at = None, 1, False, True, 0
    text = text.replace("_", " ")
    while at < len(text):
        if text[at] in " ()/.,-:;":
            at += 1
            continue
        m = _NEXT.match(text, at)
        while m:
            end = m.end()
            joined = _BARE_LATIN.match(text, end - 1) and end < len(text) and text[end].isalpha() and text[end].isascii()
            if not joined:
                break
            shorter = next((w for w in sorted((w for w in _WORDS if text.startswith(w, at) and len(w) < end - at), key=len, reverse=True)), None)
            m = re.compile(re.escape(shorter)).match(text, at) if shorter else None
        if not m:
            clean = False
            at += 1
            continue
        kind, what = _WORDS[m.group()]
        if kind == "unit":
            if unit is None or unit[0] == "count":
                unit = what
        elif kind == "scale":
            scale, scaled = scale * what, True
        at = m.end()
    return unit, scale, scaled, clean


def _split_number(digits: str, continental: bool) -> tuple[int, int]:
    """Mantissa and decimals of a number with any grouping."""
    digits = digits.replace(" ", "").replace("'", "").replace("٬", ",g").replace("٫", ".d").rstrip(".,")
    if "g" in digits or "d" in digits:
        digits = digits.replace(",g", "").replace(".d", ".")
        whole, _, part = digits.partition(".")
        return int(whole + part), len(part)
    comma, dot = digits.rfind(","), digits.rfind(".")
    if comma >= 0 and dot >= 0:
        point = max(comma, dot)
    elif comma >= 0:
        tail = len(digits) - comma - 1
        point = comma if digits.count(",") == 1 and (tail != 3 or continental and digits.startswith("0")) else -1
    elif dot >= 0:
        tail = len(digits) - dot - 1
        point = -1 if digits.count(".") > 1 or continental and tail == 3 else dot
    else:
        point = -1
    whole, part = (digits[:point], digits[point + 1 :]) if point >= 0 else (digits, "")
    return int(re.sub(r"\D", "", whole) + part or 0), len(part)


def read_measure(written: str | None) -> Measure | None:
    """The quantity that ``written`` states; None for null, empty and texts without a number.

    Parentheses around the amount, a minus sign before it or before its currency mean minus. Digits of all scripts
    count, with grouping by threes or by twos, by comma, stop, apostrophe or blank; decimal commas are told by their
    place and by the language of the words around.
    """
    if not written:
        return None
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", written).translate(_DIGITS).replace("−", "-").replace("–", "-").replace("’", "'")).strip()
    low = text.lower()
    m = _NUMBER.search(low)
    if m and m.group().startswith("000") and m.start() and low[m.start() - 1] == "'":
        m = None
    if not m:
        return None
    number = m.group()
    end = m.start() + len(number.rstrip(".,' "))
    if low[end : end + 4] == "'000":
        pass
    elif number.endswith("'000"):
        end -= 4
    elif (at := number.find(" '")) > 0:
        end = m.start() + at
    before, after = low[: m.start()], low[end:]
    around = before + " " + after
    mantissa, decimals = _split_number(low[m.start() : end], bool(_CONTINENTAL.search(around)))
    opened = before.rstrip().endswith("(") or before.strip().startswith("(") and ")" in after
    negative = opened and ")" in after or before.strip().startswith("-") or before.rstrip().endswith("-")
    unit, scale, scaled, _ = read_words(re.sub(r"\s+", " ", around.replace("-", " ", 1) if before.strip().startswith("-") else around).strip())
    return Measure(-mantissa if negative else mantissa, decimals, scale, scaled, unit)


def to_base(m: Measure, unit: tuple[str, int, int], scale: int) -> int:
    """The measure in ``unit`` as an integer of the kept measure; halves, which exact data lack, go to the even side."""
    top, low = m.mantissa * scale * unit[1], 10**m.decimals * unit[2]
    whole, rest = divmod(abs(top), low)
    whole += 2 * rest > low or 2 * rest == low and whole % 2
    return whole if top >= 0 else -whole


_BRACKET = re.compile(r"\(([^()\n]{1,40})\)")
_ROW_END = re.compile(r"\s[(\-−]?\d(?:[\d.,'٫٬]*\d)?[)]?%?$")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")


@lru_cache(maxsize=20_000)
def declaration(inside: str) -> tuple[tuple[str, int, int], int] | None:
    """Unit and scale that the words in a bracket declare; None where they are not a declaration. A scale alone counts."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", inside).replace("’", "'")).strip().lower()
    if re.search(r"\d", text.replace("'000", "")):
        return None
    unit, scale, scaled, clean = read_words(text)
    if not clean or unit is None and not scaled:
        return None
    return unit or ("count", 1, 1), scale


def table_rows(page: str | None) -> list[tuple[int, int, str]]:
    """Table rows of a page as (start, end, code): units between blank lines that end in a plain number.

    The code is that of the unit declared in the row, else of the nearest one declared above it; empty without one.
    """
    out, code, at = [], "", 0
    if not page:
        return out
    for stop, again in [*((m.start(), m.end()) for m in _BLANK_LINE.finditer(page)), (len(page), len(page))]:
        block = page[at:stop].rstrip()
        start, at = at, again
        if "(" in block and not re.search(r"[.!?।。؟！？][\"'”»)]*$", block):
            for m in _BRACKET.finditer(block):
                if d := declaration(m.group(1)):
                    code = to_code(*d)
        if _ROW_END.search(block):
            out.append((start, start + len(block), code))
    return out


def to_code(unit: tuple[str, int, int], scale: int) -> str:
    return f"{unit[0]}|{unit[1]}|{unit[2]}|{scale}"


def from_code(code: str) -> tuple[tuple[str, int, int], int]:
    base, num, den, scale = code.split("|")
    return (base, int(num), int(den)), int(scale)
