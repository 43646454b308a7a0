"""The report in markdown: three kinds of cases and a self-audit, each chosen by its shape."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, Row, functions as F

from claimlake.operators import serve
from claimlake.operators.store import Store

WIDTH = 92


def _wrap(text: str, lead: str = "") -> str:
    return "\n".join(textwrap.wrap(text, WIDTH, initial_indent=lead, subsequent_indent=lead))


def _side(name: str, f: Row) -> str:
    context = ", ".join(f"{k}={v}" for k, v in sorted((f["context"] or {}).items())) or "none stated"
    return (
        f"- **{name}:** `{f['display']}`, {f['metric']}\n  - source: {f['source']}, page {f['page_no']} (characters {f['char_start']} to {f['char_end']})\n"
        f"  - period: {f['period_label'] or 'not stated'}; context: {context}; confidence: {f['confidence']}\n  - evidence:\n{_wrap((f['evidence'] or '').strip(), '  > ')}\n"
    )


def _case(store: Store, chosen: DataFrame, facts: DataFrame) -> list[str]:
    """One block for each chosen relation; a handful of rows reach the driver."""
    rows = store.read("relations").join(chosen.select("relation_id"), "relation_id", "left_semi").collect()
    ids = [i for r in rows for i in (r["left_id"], r["right_id"])]
    sides = {f["fact_id"]: f for f in facts.where(F.col("fact_id").isin(ids)).collect()} if ids else {}
    order = {r["relation_id"]: i for i, r in enumerate(chosen.collect())}
    return [
        f"**Verdict:** `{r['relation']}` (confidence {r['confidence']}, found by {r['basis']})\n\n{_wrap(r['explanation'])}\n\n{_side('Fact A', sides[r['left_id']])}{_side('Fact B', sides[r['right_id']])}"
        for r in sorted(rows, key=lambda r: order[r["relation_id"]])
    ]


def render(store: Store, collection: str | None = None) -> str:
    """The report over what the store holds, for one collection or all. The audit's page count covers all collections."""
    documents, facts, relations = store.read("documents"), store.read("facts"), store.read("relations")
    joined = serve.filtered(serve.joined_relations(relations, facts, documents), collection=collection)
    cited = facts.join(documents.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("source")), "doc_id")
    n = {r["measure"]: r["n"] for r in store.stats().collect()}
    out = [f"# Cases\n\nFrom {n['documents']} documents, {n['pages']} pages, {n['facts']} facts and {n['relations']} relations" + (f", collection `{collection}`." if collection else ".")]
    for title, chosen in (
        ("Corroborated across documents", serve.report_corroboration(joined, facts)),
        ("A likely contradiction", serve.report_contradiction(joined, facts)),
        ("Explained by context", serve.report_reconciled(joined, facts)),
    ):
        out += [f"## {title}", *(_case(store, chosen, cited) or ["_None found._"])]
    mine = facts if collection is None else facts.join(documents.where(F.col("collection") == collection).select("doc_id"), "doc_id", "left_semi")
    audit = serve.diagnostics(mine, store.read("pages")).first()
    signals = {"Facts": "n_facts", "Facts without a period": "no_period", "Facts with a one-word metric": "one_word_metric", "Facts in incomparable units": "incomparable_unit"}
    rows = [f"| {name} | {audit[c]} | {audit[c] / max(audit['n_facts'], 1):.0%} |" for name, c in signals.items()]
    weakest = relations.join(serve.weakest_contradictions(relations, facts).select("relation_id"), "relation_id", "left_semi").collect()
    out += ["## Self-audit", "\n".join(["| Signal | Count | Share |", "| --- | ---: | ---: |", *rows, f"| Reordered pages | {audit['reordered_pages']} | |"]), *(_wrap(r["explanation"], "- ") for r in weakest)]
    return "\n\n".join(out) + "\n"
