"""Refining weak facts through a pluggable client, every proposal of which must prove itself against the page."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimlake.functions import metrics, periods, qualifiers
from claimlake.operators import relate, serve

BATCH = 25
PROPOSAL = "fact_id string, metric string, period string, context map<string, string>, evidence_quote string, usable boolean"
#: A client takes (fact_id, metric, evidence, page text) rows and returns proposals as dicts; it may leave facts out.
Client = Callable[[Sequence[tuple]], list[dict]]


def _flat(text: str | None) -> str:
    return " ".join((text or "").split())


def refine(facts: DataFrame, pages: DataFrame, client: Client, limit: int = 200) -> DataFrame:
    """Facts with the client's grounded proposals applied.

    Only the ``limit`` weakest facts are asked about, in batches of BATCH from one task. A quote that is not on the page (white space aside) rejects the proposal; a
    period is read again from the words proposed; unknown context dimensions are dropped; a fact called unusable goes;
    value, unit, display and place never change. Facts the client says nothing about stay as they are.
    """
    few = serve.refiner_candidates(facts, relate.GENERIC, limit).select("fact_id")  # at most ``limit`` rows
    weak = facts.join(F.broadcast(few), "fact_id", "left_semi").select("fact_id", "doc_id", "page_no", "metric", "evidence")
    texts = pages.select("doc_id", "page_no", "text").join(F.broadcast(weak.select("doc_id", "page_no").distinct()), ["doc_id", "page_no"], "left_semi")
    # pages are narrowed where they lie; only the facts asked about and their pages come together for the client's batches
    asked = weak.join(texts, ["doc_id", "page_no"], "left").select("fact_id", "metric", "evidence", "text").repartition(1)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["fact_id", "metric", "metric_key", "period_label", "period_kind", "period_start", "period_end", "context", "usable"]
        for frame in batches:
            for at in range(0, len(frame), BATCH):
                part = list(frame.iloc[at : at + BATCH].itertuples(index=False, name=None))
                pages_of, out = {r[0]: r[3] for r in part}, []
                for p in client(part):
                    if p.get("fact_id") not in pages_of:
                        continue
                    quote = _flat(p.get("evidence_quote"))
                    if p.get("usable", True) and (not quote or quote not in _flat(pages_of[p["fact_id"]])):
                        continue
                    when = next(iter(periods.find_periods(p.get("period"))), None)
                    context = {d: v for d, v in (p.get("context") or {}).items() if d in qualifiers.LEXICON}
                    metric = (p.get("metric") or "").strip() or None
                    out.append((p["fact_id"], metric, metric and metrics.metric_key(metric), when and when.label, when and when.kind, when and when.start, when and when.end, context, p.get("usable", True)))
                yield pd.DataFrame(out, columns=columns)

    schema = "fact_id string, metric string, metric_key string, period_label string, period_kind string, period_start date, period_end date, context map<string, string>, usable boolean"
    said = asked.mapInPandas(ask, schema).select("fact_id", F.struct("metric", "metric_key", "period_label", "period_kind", "period_start", "period_end", "context", "usable").alias("p"))
    joined = facts.join(said, "fact_id", "left").where(F.coalesce("p.usable", F.lit(True)))
    applied = F.col("p").isNotNull()
    change = {c: F.coalesce(f"p.{c}", c) for c in ("metric", "metric_key")}
    dated = F.col("p.period_label").isNotNull()
    change |= {c: F.when(dated, F.col(f"p.{c}")).otherwise(F.col(c)) for c in ("period_label", "period_kind", "period_start", "period_end")}
    merged = F.map_concat(F.map_filter("context", lambda k, _: ~F.array_contains(F.map_keys("p.context"), k)), "p.context")
    change |= {"context": F.when(applied, merged).otherwise(F.col("context")), "extractor": F.when(applied, "rules+llm").otherwise(F.col("extractor"))}
    return joined.withColumns(change).drop("p")


def refiner_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(asked_facts, applied, dropped)`` of a refinement."""
    pair = before.select("fact_id").join(after.select("fact_id", "extractor"), "fact_id", "left")
    return pair.agg(F.count("*").alias("facts"), F.count_if(F.col("extractor") == "rules+llm").alias("applied"), F.count_if(F.col("extractor").isNull()).alias("dropped"))
