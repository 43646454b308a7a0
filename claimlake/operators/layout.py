"""Pages from positioned lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimlake.functions import layout as L

LINES = "doc_id string, page_no int, page_w double, page_h double, line_no int, x0 double, y0 double, x1 double, y1 double, text string"
CELL = "text: string, at: int, to: int, x0: double, x1: double, y0: double, y1: double, line: int, numeric: boolean"
PAGE = f"doc_id string, page_no int, text string, n_columns int, printed_label string, cells array<struct<{CELL}>>"
ORDER = "doc_id string, page_no int, line_no int, place int, leaf int, n_columns int"


def scan_lines(lines: DataFrame) -> DataFrame:
    """Lines fit for layout: normal text of two characters or more."""
    from claimlake.functions.udfs import normalise_text

    return lines.withColumn("text", normalise_text("text")).where(F.length("text") >= 2)


def _lines(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[L.Line]]:
    pdf = pdf.sort_values("line_no", kind="stable")
    return pdf, [L.Line(*r) for r in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], pdf["text"])]


def pages_from_lines(lines: DataFrame) -> DataFrame:
    """Text, columns, printed label and cells of every page; one task handles one page, whose lines are bounded."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _lines(pdf)
        first = pdf.iloc[0]
        text, n, cells = L.page_from_lines(rows, first["page_w"], first["page_h"])
        return pd.DataFrame([{"doc_id": first["doc_id"], "page_no": first["page_no"], "text": text, "n_columns": n, "printed_label": L.printed_label(rows, first["page_h"]), "cells": [c._asdict() for c in cells]}])

    return lines.groupBy("doc_id", "page_no").applyInPandas(build, PAGE)


def reading_order(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_no, line_no, place, leaf, n_columns)``: where each line comes in reading order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _lines(pdf)
        order, leaf, n = L.reading_order(rows, pdf["page_w"].iloc[0], pdf["page_h"].iloc[0])
        out = pdf.iloc[order][["doc_id", "page_no", "line_no"]].copy()
        return out.assign(place=range(len(order)), leaf=[leaf[i] for i in order], n_columns=n)

    return lines.groupBy("doc_id", "page_no").applyInPandas(build, ORDER)


def visual_rows(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_no, row_no, text, n_cells)``: pieces of one baseline joined, in reading order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = _lines(pdf)
        order, leaf, _ = L.reading_order(rows, pdf["page_w"].iloc[0], pdf["page_h"].iloc[0])
        found = L.visual_rows([rows[i] for i in order], [leaf[i] for i in order])
        return pd.DataFrame([(pdf["doc_id"].iloc[0], pdf["page_no"].iloc[0], n, r.text, len(r.cells)) for n, r in enumerate(found)], columns=["doc_id", "page_no", "row_no", "text", "n_cells"])

    return lines.groupBy("doc_id", "page_no").applyInPandas(build, "doc_id string, page_no int, row_no int, text string, n_cells int")


def gutters(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_no, middle, width)`` of the widest channel of each page that has one."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        found = L.find_gutter(_lines(pdf)[1])
        rows = [(pdf["doc_id"].iloc[0], pdf["page_no"].iloc[0], *found)] if found else []
        return pd.DataFrame(rows, columns=["doc_id", "page_no", "middle", "width"])

    return lines.groupBy("doc_id", "page_no").applyInPandas(build, "doc_id string, page_no int, middle double, width double")


def cells(pages: DataFrame) -> DataFrame:
    """Cells of pages, one row each, numbered in page order as ``cell_no``."""
    return pages.select("doc_id", "page_no", F.posexplode("cells").alias("cell_no", "c")).select("doc_id", "page_no", "cell_no", "c.*")


def _neighbours(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numeric cells and, beside them, cells of other lines of the same page."""
    keys = ["doc_id", "page_no"]
    value = cells.where("numeric").select(*keys, *(F.col(c).alias(f"v_{c}") for c in ("cell_no", "x0", "x1", "y0", "y1", "line", "text")))
    return value, value.join(cells, keys).where(F.col("line") != F.col("v_line"))


def captions(cells: DataFrame) -> DataFrame:
    """The caption of each numeric cell: ``(doc_id, page_no, v_cell_no, caption_no, caption)``. A theta self-join within pages."""
    from claimlake.functions.columns import is_caption

    reach = F.greatest(F.col("v_y1") - F.col("v_y0"), F.lit(1.0)) * L.CAPTION_LINES
    inner = F.least("x1", "v_x1") - F.greatest("x0", "v_x0")
    cover = F.when(inner > 0, inner / (F.greatest("x1", "v_x1") - F.least("x0", "v_x0"))).otherwise(0.0)
    near = _neighbours(cells)[1].withColumns({"far": F.abs((F.col("y0") + F.col("y1")) - (F.col("v_y0") + F.col("v_y1"))) / 2, "reach": reach, "cover": cover})
    near = near.where((F.col("far") <= F.col("reach")) & (F.col("cover") >= L.CAPTION_OVERLAP) & is_caption(F.col("text"), F.col("numeric")))
    score = F.col("cover") - F.col("far") / F.col("reach") * 0.15
    best = F.max_by(F.struct("cell_no", "text"), F.struct(score, -F.col("cell_no"))).alias("b")
    return near.groupBy("doc_id", "page_no", "v_cell_no").agg(best).select("doc_id", "page_no", "v_cell_no", F.col("b.cell_no").alias("caption_no"), F.col("b.text").alias("caption"))


def column_headers(cells: DataFrame) -> DataFrame:
    """Cells that head the column of each numeric cell: ``(doc_id, page_no, v_cell_no, header_no, header, gap)``."""
    height, width = F.greatest(F.col("v_y1") - F.col("v_y0"), F.lit(1.0)), F.greatest(F.col("v_x1") - F.col("v_x0"), F.lit(1.0))
    gap = F.col("v_y0") - F.col("y1")
    covers = (F.least("x1", "v_x1") - F.greatest("x0", "v_x0")) / width >= L.HEADER_COVER
    found = _neighbours(cells)[1].where((gap >= 0) & (gap <= height * L.HEADER_LINES) & covers)
    return found.select("doc_id", "page_no", "v_cell_no", F.col("cell_no").alias("header_no"), F.col("text").alias("header"), gap.alias("gap"))


def cell_at(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """For ``spans(doc_id, page_no, span_at, span_to)`` the first cell that holds them, else the first that touches them."""
    keys = ["doc_id", "page_no"]
    hit = spans.join(cells, keys).where((F.col("span_at") < F.col("to")) & (F.col("at") < F.col("span_to")))
    whole = ((F.col("at") <= F.col("span_at")) & (F.col("span_to") <= F.col("to"))).cast("int")
    return hit.groupBy(*keys, "span_at", "span_to").agg(F.min_by("cell_no", F.struct(-whole, F.col("cell_no"))).alias("cell_no"))
