"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO60 = 1 << 60


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one blank; outer ones go."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def round3(x: Column) -> Column:
    """``x`` (0 to 7) at three decimals, rounded on its exact binary value, halves to even.

    Decimal rounding works on the shortest decimal form and so disagrees for values such as 0.95 * 0.85.
    """
    exact = (x * F.lit(float(_TWO60))).cast("long").cast("decimal(20,0)") * F.lit(1000)
    below = F.call_function("div", exact, F.lit(_TWO60).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = exact - below * F.lit(_TWO60).cast("decimal(20,0)")
    half = F.lit(_TWO60 // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (below % 2 == 1))
    return (below.cast("double") + up.cast("int")) / F.lit(1000.0)


def fixed2(x: Column) -> Column:
    """``x`` (0 to 2**40) written with two decimals, rounded on its exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal form half up, which differs where that form ends in a 5 at the third
    decimal; there the sign of ``1000 x - m`` tells, whose products are exact on the halves of ``x``.
    """
    m = F.rint(x * 1000.0)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    rest = (high * 1000.0 - m) + (x - high) * 1000.0
    below = (m - 5.0) / 10.0
    up = (rest > 0) | ((rest == 0) & (below % 2 == 1))
    tie = (m / 1000.0 == x) & (m % 10 == 5)
    return F.format_string("%.2f", F.when(tie, (below + up.cast("int")) / 100.0).otherwise(x))


def short_label(title: Column, filename: Column, width: int = 52) -> Column:
    """A title fit for citing: the file name where empty, cut at a word beyond ``width`` characters."""
    name = F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, collapse_ws(title)).otherwise(filename)
    cut = F.regexp_replace(F.substring(name, 1, width), r"\s\S*$", "")
    return F.when(F.length(name) <= width, name).otherwise(F.concat(F.regexp_replace(cut, r"[,;:\s]+$", ""), F.lit("…")))


def relation_id(left: Column, right: Column, relation: Column, basis: Column) -> Column:
    """Identity of a relation, the same whichever side comes first."""
    return F.substring(F.sha1(F.concat_ws("|", F.least(left, right), F.greatest(left, right), relation, basis)), 1, 16)


def fact_id(doc_id: Column, page_no: Column, value_start: Column, value_end: Column, metric: Column) -> Column:
    """Identity of a fact: the place of its value and its metric."""
    parts = [doc_id, page_no.cast("string"), value_start.cast("string"), value_end.cast("string"), metric]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def fiscal_year(day: Column) -> Column:
    """Year in which the fiscal year of ``day`` ends; fiscal years start in April."""
    return F.year(day) + (F.month(day) >= 4).cast("int")


def fiscal_quarter(day: Column) -> Column:
    return F.floor(F.pmod(F.month(day) - 4, F.lit(12)) / 3).cast("int") + 1


def period_relation(la: Column, sa: Column, ea: Column, lb: Column, sb: Column, eb: Column) -> Column:
    """How two reporting periods lie: same, unknown, different, contains, within, overlaps or disjoint.

    Labels go before dates, so equal bounds under different labels count as contains.
    """
    known = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    dated = sa.isNotNull() & ea.isNotNull() & sb.isNotNull() & eb.isNotNull()
    return (
        F.when(known(la) & (la == lb), "same")
        .when(~known(la) | ~known(lb), "unknown")
        .when(~dated, "different")
        .when((sa <= sb) & (eb <= ea), "contains")
        .when((sb <= sa) & (ea <= eb), "within")
        .when((sa <= eb) & (sb <= ea), "overlaps")
        .otherwise("disjoint")
    )


def value_gap(va: Column, vb: Column) -> Column:
    return F.abs(va - vb)


def values_agree(va: Column, pa: Column, vb: Column, pb: Column) -> Column:
    """Whether the coarser figure's rounding interval holds the finer one; a thousandth of the larger is always allowed."""
    size = F.greatest(F.abs(va), F.abs(vb), F.lit(1e-12))
    return value_gap(va, vb) <= F.greatest(F.greatest(pa, pb) * 0.5, size * 0.001)


def months_apart(a: Column, b: Column) -> Column:
    """Calendar months between two dates, days aside."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def bridge_bucket(value: Column) -> Column:
    """``value`` rounded to three significant figures: figures that may be one under another scale share it."""
    whole = F.length(F.floor(F.abs(value)).cast("decimal(38,0)").cast("string"))
    digits = F.when(F.abs(value) >= 1, whole).otherwise(0)
    unit = F.pow(F.lit(10.0), (digits - 3).cast("double"))
    return F.when(digits >= 3, F.rint(value / unit) * unit).otherwise(F.rint(value * F.pow(F.lit(10.0), (F.lit(3) - digits).cast("double"))) / F.pow(F.lit(10.0), (F.lit(3) - digits).cast("double")))


def is_caption(text: Column, numeric: Column) -> Column:
    """Whether text can caption a number: few words, mostly letters, one of three letters or more, not ``numeric`` itself."""
    words = F.filter(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), lambda w: F.length(w) > 0)
    solid = F.regexp_replace(text, r"(?U)\s", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    return ~numeric & F.size(words).between(1, 12) & (letters / F.greatest(F.length(solid), F.lit(1)) >= 0.6) & F.exists(words, lambda w: w.rlike(r"^\p{L}{3,}$"))
