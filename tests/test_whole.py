"""Queries that give the whole of what another query's SQL states in part, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimlake.functions import columns as C, udfs as U
from claimlake.functions.stem import stem
from claimlake.operators import relate as R
from claimlake.sources import claims as T

ROOT = "/root/testdata/sf0.001"


def test_details_of_every_fact(spark):
    shown = {r["fact_id"]: r["display"] for r in T.facts(spark, ROOT, "display").collect()}
    ends = [(a, r["relation_id"], r["relation"], b) for r in T.relations(spark, ROOT).collect() for a, b in ((r["left_id"], r["right_id"]), (r["right_id"], r["left_id"]))]
    wanted = Counter((*e, shown[e[3]]) for e in ends if e[3] in shown)
    assert Counter(map(tuple, entry.queries()["fact_detail_every"](spark, ROOT).collect())) == wanted
    few = {f for f, n in Counter(e[0] for e in ends).items() if n < 10}
    assert few & {e[0] for e in wanted}


def label(d):
    name = " ".join((d["title"] or "").split()) or d["filename"]
    return name if len(name) <= 52 else re.sub(r"[,;:\s]+$", "", re.sub(r"\s\S*$", "", name[:52])) + "…"


def told(a, b, da, db, kind, concept):
    """The explanation of one pair in plain Python."""
    la, lb = f"{label(da)} p.{a['page_no']}", f"{label(db)} p.{b['page_no']}"
    name = a["metric"] if a["metric_key"] == b["metric_key"] else concept or a["metric"]
    subject = a["subject"] if a["subject_key"] == b["subject_key"] else f"{a['subject']}/{b['subject']}"
    clause = f" in {a['period_label']}" if a["period_label"] else ""
    gap = abs(a["value"] - b["value"])
    share = 100.0 * gap / max(abs(a["value"]), abs(b["value"]), 1e-12)
    by = f"{gap:.2f} percentage points" if a["unit"] in ("percent", "percentage_point") else f"{share:.2f}%"
    same = a["period_label"] and a["period_label"] == b["period_label"]
    spans = [x[k] for x in (a, b) for k in ("period_start", "period_end")]
    inside = bool(a["period_label"] and b["period_label"] and all(spans)) and not same
    holds, held = inside and spans[0] <= spans[2] and spans[3] <= spans[1], inside and spans[2] <= spans[0] and spans[1] <= spans[3]
    whole, part = (a, b) if holds else (b, a)
    cw, cp = (la, lb) if holds else (lb, la)
    sits = f"{part['period_label']} sits inside {whole['period_label']}"
    if kind == "part_of":
        note = "The component does not exceed the total, as expected." if abs(part["value"]) <= abs(whole["value"]) * 1.001 else "The component exceeds the total it sits inside, which one of the two figures cannot survive."
        return f"{sits}, so {part['display']} ({cp}) is a component of {whole['display']} ({cw}) for {name} of {subject}. {note}"
    if kind == "corroborates":
        return f"{la} and {lb} both report {name} for {subject}{clause}: {a['display']} and {b['display']}. They differ by {by}, inside the tolerance implied by the precision each document states."
    if kind == "contradicts":
        return f"{name} for {subject}{clause} is reported as {a['display']} by {la} and {b['display']} by {lb}. No difference in period, basis, vintage or adjustment was found between the two statements, and the gap of {by} is larger than their stated precision allows."
    first, second = (label(da), label(db)) if label(da) != label(db) else ("the first statement", "the second")
    reasons = [sits] if holds or held else []
    if not (same or holds or held):
        reasons.append(f"{first} covers {a['period_label'] or 'an unstated period'} while {second} covers {b['period_label'] or 'an unstated period'}")
    ca, cb = a["context"] or {}, b["context"] or {}
    differ = [d for d in sorted(R.READABLE) if ca.get(d) != cb.get(d)]
    read = lambda d, v: R.READABLE[d].get(v, v or "no stated basis")
    reasons += [f"{first} reports {read(d, ca.get(d))} while {second} reports {read(d, cb.get(d))}" for d in differ]
    pa, pb = da["published_on"], db["published_on"]
    if "vintage" not in differ and {ca.get("vintage"), cb.get("vintage")} & set(R.UNSETTLED) and pa and pb and abs((pa.year - pb.year) * 12 + pa.month - pb.month) >= 3:
        reasons.append(f"{first} reports {pa} while {second} reports {pb}")
    pair = f"{a['display']} ({la}) and {b['display']} ({lb})"
    if kind == "consistent_across_context":
        return f"{pair} agree on {name} for {subject} even though they are stated differently: {'; '.join(reasons)}."
    return f"{pair} both report {name} for {subject} and differ by {by}, but they are not in conflict: {'; '.join(reasons)}."


def test_whole_explanations(spark):
    root = "/root/testdata/sf0.01"  # the smallest scale has no contradictions
    facts = {r["fact_id"]: r for r in T.facts(spark, root).collect()}
    docs = {r["doc_id"]: r for r in T.documents(spark, root).collect()}
    concepts = {r["concept_id"]: r["label"] for r in T.concepts(spark, root).collect()}
    got = entry.queries()["explanations_whole"](spark, root).collect()
    assert len({r["relation"] for r in got}) == 5
    for r in got:
        a, b = facts[r["left_id"]], facts[r["right_id"]]
        assert r["explanation"] == told(a, b, docs[a["doc_id"]], docs[b["doc_id"]], r["relation"], concepts.get(a["concept_id"])), r


def test_two_decimals_are_exact(spark):
    rng = random.Random(3)
    values = [k / 1000 for k in range(5, 4000, 10)] + [0.125, 0.375, 2.675, 1e9 + 0.125, 1e9 + 0.375, 0.0, 200.0] + [round(rng.uniform(0, 10**e), 3) for e in range(9) for _ in range(40)] + [rng.uniform(0, 200) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(C.fixed2(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]


def test_search_over_the_stemmed_index(spark):
    facts = T.facts(spark, ROOT, "metric", "evidence", "subject").collect()
    stems = {r["fact_id"]: {f: [stem(w) for w in re.findall(r"[^\W_]+", (r[f] or "").lower())] for f in ("metric", "evidence", "subject")} for r in facts}
    every = {k: {w for ws in v.values() for w in ws} for k, v in stems.items()}
    has = lambda k, *words: any(stem(w) in every[k] for w in words)
    wanted = {k for k in every if (has(k, "haulage") or stem("parcels") in stems[k]["metric"]) and has(k, "growth", "standing", "stood") and not has(k, "grains")}
    assert wanted and {r[0] for r in entry.queries()["search_facts_stemmed"](spark, ROOT).collect()} == wanted
    n = Counter((w, f) for v in stems.values() for f, ws in v.items() for w in ws)
    n_facts = Counter((w, f) for v in stems.values() for f, ws in v.items() for w in set(ws))
    got = {(r["token"], r["field"]): (r["n"], r["n_facts"]) for r in entry.queries()["fts_index_stemmed"](spark, ROOT).collect()}
    assert got == {k: (n[k], n_facts[k]) for k in n}


KERNELS = {"quantities_pages": U.page_quantities, "periods_pages": U.find_periods, "qualifiers_pages": U.find_qualifiers, "units_pages": U.units}


@pytest.mark.parametrize("name", KERNELS)
def test_kernels_over_pages(spark, name):
    """Every page is read whole: what comes out is what the kernel finds page by page."""
    pages = T.pages(spark, ROOT).where("text is not null").collect()
    found = KERNELS[name].func(pd.Series([p["text"] for p in pages]))
    wanted = Counter((p["doc_id"], p["page_no"]) for p, f in zip(pages, found) for _ in f)
    got = entry.queries()[name](spark, ROOT).collect()
    assert wanted and Counter((r["doc_id"], r["page_no"]) for r in got) == wanted
    text = {(p["doc_id"], p["page_no"]): p["text"] for p in pages}
    for r in got:
        assert 0 <= r["at"] < r["to"] <= len(text[r["doc_id"], r["page_no"]])


def test_declared_units_hold_for_rows_below_them():
    page = "Table 3 (₹ Cr)\n\nNet loss 12 (4)\n\nSales rose to 4,500 last year."
    (found,) = U.page_quantities.func(pd.Series([page]))
    assert {page[q["at"] : q["to"]]: q["unit"] for q in found}["4,500"] == "count" and any(q["unit"] == "INR" and page[q["at"] : q["to"]].startswith("12") for q in found)


def test_lines_and_texts_of_pages(spark):
    pages = {(p["doc_id"], p["page_no"]): p["text"] for p in T.pages(spark, ROOT).where("text is not null").collect()}
    lines = Counter((r["doc_id"], r["page_no"]) for r in entry.queries()["declared_units_pages"](spark, ROOT).collect())
    assert lines == Counter({k: t.count("\n") + 1 for k, t in pages.items()})
    got = {(r["doc_id"], r["page_no"]): r["text"] for r in entry.queries()["normalised_pages"](spark, ROOT).collect()}
    assert got == dict(zip(pages, U.normalise_text.func(pd.Series(list(pages.values())))))
