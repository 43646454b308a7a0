"""Arrow kernels: the pure functions of this package over columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from claimlake.functions import facts as X, layout, metrics, periods, qualifiers, quantities, text as N
from claimlake.plans.spread import spread

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()  # noqa: E741


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PERIOD = _struct(label=S, kind=S, start=T.DateType(), end=T.DateType(), raw=S, at=I, to=I)
QUANTITY = _struct(raw=S, at=I, to=I, value=D, unit=S, shown=D, scale_word=S, currency=S, confidence=D, precision=D)
QUALIFIER = _struct(dimension=S, value=S, raw=S, at=I, to=I)
UNIT = _struct(at=I, to=I, kind=S)
DECLARED = _struct(currency=S, scale=D, word=S, percent=T.BooleanType())
VOTES = T.MapType(S, I)


@F.pandas_udf(S)
def normalise_text(texts: pd.Series) -> pd.Series:
    return texts.map(N.normalise)


@F.pandas_udf(T.ArrayType(UNIT))
def units(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [u._asdict() for u in N.units(t)])


@F.pandas_udf(T.ArrayType(PERIOD))
def find_periods(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [p._asdict() for p in periods.find_periods(t)])


@F.pandas_udf(T.ArrayType(PERIOD))
def earlier_periods(texts: pd.Series) -> pd.Series:
    """Periods of a text, each a year earlier."""
    return texts.map(lambda t: [periods.shift_back(p)._asdict() for p in periods.find_periods(t)])


def each_once(kernel: Callable, kind: T.DataType, *columns: pa.Array) -> pa.Array:
    """``kernel`` over the rows of ``columns``; rows of a batch that are equal are read once and their result repeated."""
    places: dict[tuple, int] = {}
    if len(columns) == 1 and pa.types.is_string(columns[0].type):
        coded = columns[0].dictionary_encode(null_encoding="encode")
        rows, at = [(t,) for t in coded.dictionary.to_pylist()], coded.indices
    else:
        keys = zip(*(c.to_pylist() for c in columns))
        at = pa.array([places.setdefault(tuple(tuple(v) if isinstance(v, list) else v for v in k), len(places)) for k in keys], "int32")
        rows = list(places)
    return pa.array([kernel(*r) for r in rows], to_arrow_type(kind)).take(at)


QUANTITIES = T.ArrayType(QUANTITY)


@F.arrow_udf(QUANTITIES)
def find_quantities(texts: pa.Array) -> pa.Array:
    """Quantities of a text, its periods masked."""
    read = lambda t: [q._asdict() for q in quantities.find_quantities(t, [(p.at, p.to) for p in periods.find_periods(t)], quantities.declared_unit(t))]
    return each_once(read, QUANTITIES, texts)


def _on_page(page: str) -> list[dict]:
    out = []
    for u in N.units(page):
        text = page[u.at : u.to]
        declared = quantities.declared_unit(text)
        if declared == quantities.Declared() and u.kind == "row":
            declared = quantities.declared_unit(page[max(0, u.at - X.LOOKBACK) : u.at])
        found = quantities.find_quantities(text, [(p.at, p.to) for p in periods.find_periods(text)], declared)
        out += [q._replace(at=q.at + u.at, to=q.to + u.at)._asdict() for q in found]
    return out


@F.pandas_udf(T.ArrayType(QUANTITY))
def page_quantities(texts: pd.Series) -> pd.Series:
    """Quantities of whole pages, unit by unit; rows inherit the unit declared shortly above them, as facts do."""
    return texts.map(_on_page)


@F.pandas_udf(T.ArrayType(QUALIFIER))
def find_qualifiers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [q._asdict() for q in qualifiers.find_qualifiers(t)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def context_said(texts: pd.Series) -> pd.Series:
    """:func:`claimlake.functions.qualifiers.as_context` of the qualifiers of a column."""
    return texts.map(lambda t: qualifiers.as_context(qualifiers.find_qualifiers(t)))


@F.pandas_udf(T.DoubleType())
def span_distance(texts: pd.Series, at: pd.Series, to: pd.Series, value_at: pd.Series, value_to: pd.Series) -> pd.Series:
    """How far a mention stands from a value of its text, brackets counted."""
    value = lambda a, b: quantities.Quantity("", a, b, 0.0, "", 0.0, "", None, 0.0, 0.0)
    return pd.Series([X.Brackets(t).distance(int(a), int(b), value(int(c), int(d))) for t, a, b, c, d in zip(texts, at, to, value_at, value_to)], dtype="float64")


@F.pandas_udf(T.StringType())
def metric_key(phrases: pd.Series) -> pd.Series:
    return phrases.map(metrics.metric_key)


@F.pandas_udf(T.StringType())
def subject_key(names: pd.Series) -> pd.Series:
    return names.map(N.subject_key)


@F.pandas_udf(T.BooleanType())
def is_row(texts: pd.Series) -> pd.Series:
    return texts.map(N.is_row)


@F.pandas_udf(T.IntegerType())
def content_words(phrases: pd.Series) -> pd.Series:
    return phrases.map(X.content_words).astype("int32")


@F.pandas_udf(T.BooleanType())
def is_caption(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: layout.is_caption(layout.text_cell(t)))


@F.pandas_udf(T.BooleanType())
def is_numeric(texts: pd.Series) -> pd.Series:
    """Whether a cell of nothing but these texts is a number."""
    return texts.map(lambda t: layout.text_cell(t).numeric)


@F.pandas_udf(T.BooleanType())
def is_tabular(texts: pd.Series) -> pd.Series:
    return texts.map(layout.is_tabular)


@F.pandas_udf(T.DoubleType())
def right_edge(ends: pd.Series) -> pd.Series:
    """Right margin of a column whose rows end at ``ends``."""
    return ends.map(lambda xs: layout.right_edges([layout.Row(0.0, 0.0, float(x), 1.0, 0, ()) for x in xs])[0])


@F.pandas_udf(T.BooleanType())
def is_prose(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Whether lines from ``starts`` to ``ends`` read like running text."""
    return pd.Series([layout.is_prose([layout.Line(float(a), 0.0, float(b), 1.0, "") for a, b in zip(xs, ys)]) for xs, ys in zip(starts, ends)], dtype="bool")


@F.pandas_udf(DECLARED)
def declared_unit(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([quantities.declared_unit(t) for t in texts], columns=["currency", "scale", "word", "percent"])


@F.pandas_udf(VOTES)
def subject_votes(texts: pd.Series, page_no: pd.Series) -> pd.Series:
    return pd.Series([N.subject_votes(t, int(n)) for t, n in zip(texts, page_no)], dtype=object)


@F.pandas_udf(S)
def denominator(texts: pd.Series) -> pd.Series:
    """What the first percentage of a text is a share of."""

    def first(t: str | None) -> str | None:
        q = next((q for q in quantities.find_quantities(t) if q.unit == "percent"), None)
        got = X.denominator_of(t, q.at, q.to) if q else None
        return got[0] if got else None

    return texts.map(first)


@F.pandas_udf(T.ArrayType(S))
def metric_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: metrics._TOKEN.findall(t or ""))


FACT = T.StructType(
    [
        *_struct(char_start=I, char_end=I, value_start=I, value_end=I, evidence=S, unit_kind=S, subject=S, subject_key=S, subject_source=S, metric=S, metric_key=S, value=D, unit=S, display=S, precision=D).fields,
        *_struct(period_label=S, period_kind=S, period_start=T.DateType(), period_end=T.DateType(), context=T.MapType(S, S), label_text=S, label_start=I, label_end=I, confidence=D).fields,
    ]
)


CELLS = "array<struct<text: string, at: int, to: int, x0: double, x1: double, y0: double, y1: double, line: int, numeric: boolean>>"


def _flat(f: X.Fact) -> dict:
    p, caption = f.period, f.label or (None, None, None)
    out = {k: getattr(f, k) for k in ("char_start", "char_end", "value_start", "value_end", "evidence", "unit_kind", "subject", "subject_key", "subject_source", "metric", "metric_key", "value", "unit", "display", "precision", "context", "confidence")}
    return out | {"period_label": p and p.label, "period_kind": p and p.kind, "period_start": p and p.start, "period_end": p and p.end, "label_text": caption[0], "label_start": caption[1], "label_end": caption[2]}


def facts_kernel(lexicon: dict | None = None):
    """:func:`claimlake.functions.facts.facts_on_page` of ``(text, subject, cells)`` columns, with a lexicon of one's own."""

    @F.pandas_udf(T.ArrayType(FACT))
    def facts_with_cells(texts: pd.Series, subjects: pd.Series, cells: pd.Series) -> pd.Series:
        rows = zip(texts, subjects, cells)
        return pd.Series([[_flat(f) for f in X.facts_on_page(t, s, [layout.Cell(**c) for c in cs] if cs is not None else None, lexicon)] for t, s, cs in rows], dtype=object)

    return facts_with_cells


@F.pandas_udf(T.ArrayType(FACT))
def facts_on_page(texts: pd.Series, subjects: pd.Series) -> pd.Series:
    """One fused kernel for a page: units, spans, attribution and facts in a single trip through Arrow."""
    return pd.Series([[_flat(f) for f in X.facts_on_page(t, s)] for t, s in zip(texts, subjects)], dtype=object)


def extract_facts(pages: DataFrame, documents: DataFrame, lexicon: dict | None = None) -> DataFrame:
    """Facts of ``pages(doc_id, page_no, text)`` with the subject of their document, keyed by place and metric.

    Where pages have ``cells``, numbers in tables take what headers and captions say. ``lexicon`` replaces that of
    qualifiers.

    Every fact is grounded: its evidence and display are substrings of the page at its offsets. Pages of documents that
    are not listed get facts without a subject. Null texts give none.
    """
    from claimlake.functions import columns as C

    subjects = documents.select("doc_id", F.coalesce("subject", "title").alias("doc_subject"))
    cells = F.col("cells") if "cells" in pages.columns else F.lit(None).cast(CELLS)
    scanned = spread(pages.select("doc_id", "page_no", "text", cells.alias("cells")), "doc_id", "page_no")
    found = scanned.join(subjects, "doc_id", "left").select("doc_id", "page_no", F.inline(facts_kernel(lexicon)("text", "doc_subject", "cells")))
    keyed = found.withColumns({"fact_id": C.fact_id(*(F.col(c) for c in ("doc_id", "page_no", "value_start", "value_end", "metric"))), "kind": F.lit("quantity"), "extractor": F.lit("rules")})
    return keyed.dropDuplicates(["fact_id"])


def detect_subjects(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, subject, score)``: the name with most votes in title and pages; longer names win ties, then the first in order."""
    titles = documents.select("doc_id", F.lit(0).alias("page_no"), F.col("title").alias("text"))
    texts = titles.unionByName(pages.select("doc_id", "page_no", "text")).where("text is not null")
    votes = texts.select("doc_id", F.explode(subject_votes("text", "page_no")).alias("name", "n")).groupBy("doc_id", "name").agg(F.sum("n").alias("n"))
    best = F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), -F.size(F.split("name", " ")), F.col("name"))).alias("b")
    return votes.groupBy("doc_id").agg(best).select("doc_id", F.col("b.name").alias("subject"), F.col("b.n").alias("score"))


def register(spark: SparkSession) -> None:
    """Offer the kernels in SQL, and facts of a text as a table function: ``SELECT * FROM extract_facts('...')``."""
    for f in (normalise_text, units, find_periods, earlier_periods, find_quantities, find_qualifiers, declared_unit, denominator, metric_tokens):
        spark.udf.register(f.__name__, f)

    @F.udtf(returnType="metric: string, value: double, unit: string, display: string, period_label: string, confidence: double")
    class ExtractFacts:
        def eval(self, text: str):
            for f in X.facts_on_page(text, None):
                yield f.metric, f.value, f.unit, f.display, f.period.label if f.period else None, f.confidence

    spark.udtf.register("extract_facts", ExtractFacts)
