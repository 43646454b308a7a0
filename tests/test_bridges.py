"""Bridges and their counts against pairs compared one by one."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlake.operators import relate as R

POOL = "fact_id string, doc_id string, page_no int, subject string, subject_key string, subject_source string, metric string, metric_key string, concept_id string, value double, unit string, display string, precision double, period_label string, period_start date, period_end date, context map<string,string>, confidence double, published_on date, doc_label string, collection string"
KEYS = ["freight revenue", "freight revenue net", "revenue freight growth", "freight", "total income", "income other", "parcel freight", "parcel volume", "parcel growth"]


def fact(i, **own):
    base = {"fact_id": f"f{i:06}", "doc_id": "a", "page_no": 1, "subject": "Orrin", "subject_source": "document", "metric_key": KEYS[0], "concept_id": "c1", "value": 100.0, "unit": "INR", "precision": 1.0, "period_label": "FY2024", "context": {}, "confidence": 0.9, "collection": "x"} | own
    return tuple(base.get(c.split()[0]) for c in POOL.split(", "))


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(7)
    rows = [fact(i, doc_id=r.choice("abcd"), metric_key=r.choice(KEYS), concept_id=r.choice(["c1", "c2", "c3", "", None]), value=r.choice([100.0, 100.2, 100.4, 0.0, 250.0]), precision=r.choice([0.1, 1.0, None]), unit=r.choice(["INR", "INR", "count"]), confidence=r.choice([0.5, 0.855, 0.9, None]), collection=r.choice("xy"), subject_source=r.choice(["document", "sentence"]), subject_key=r.choice(["o", None])) for i in range(220)]
    return spark.createDataFrame(rows, POOL).cache()


def bridged(spark, facts):
    """Ids, keys and confidence of all pairs, as the SQL of value_bridge has them."""
    rows = [r.asDict() for r in facts.collect() if r["unit"] not in ("count", "unknown") and r["value"] != 0 and r["confidence"] is not None]
    keys = spark.createDataFrame([(a, b) for a in KEYS for b in KEYS], "a string, b string")
    may = {(r["a"], r["b"]) for r in keys.where(R.bridgeable(keys["a"], keys["b"])).collect()}
    block = lambda f: (f["collection"], (f["subject_key"] or "") if f["subject_source"] == "sentence" else "", f["unit"], f["period_label"], round(f["value"]))
    out = {}
    for a in rows:
        for b in rows:
            first = (-a["confidence"], a["fact_id"]) < (-b["confidence"], b["fact_id"])
            if first and block(a) == block(b) and a["doc_id"] != b["doc_id"] and a["concept_id"] != b["concept_id"] and (a["metric_key"], b["metric_key"]) in may:
                if abs(a["value"] - b["value"]) <= max(max(a["precision"] or 0, b["precision"] or 0) * 0.5, max(a["value"], b["value"]) * 0.001):
                    out[a["fact_id"], b["fact_id"]] = (a["metric_key"], b["metric_key"], round(min(a["confidence"], b["confidence"]) * 0.9, 3))
    return out


def test_counts_are_those_of_the_bridges(spark, mixed):
    expected = Counter(tuple(sorted(keys)) for *keys, _ in bridged(spark, mixed).values())
    got = {(r["left_key"], r["right_key"]): r["n"] for r in R.alias_counts(mixed).collect()}
    assert got == {k: n for k, n in expected.items() if n >= R.ALIAS_VOTES}
    assert any(a == b for a, b in got)


def test_counts_of_a_block_too_large_for_pairs(spark):
    """Two wordings of 20,000 facts each in one block: nearly 400 million bridges, which are counted and not made."""
    n = 20_000
    ids = spark.range(2 * n).selectExpr("CAST(id AS STRING) fact_id", "CAST(id % 100 AS STRING) doc_id", "id % 1000 < 500 one")
    facts = ids.selectExpr("fact_id", "doc_id", "if(one, 'freight revenue', 'freight revenue net') metric_key", "if(one, 'c1', 'c2') concept_id", "'document' subject_source", "'' subject_key", "'INR' unit", "'any' period_label", "100.0D value", "1.0D precision", "0.9D confidence", "'x' collection")
    (row,) = R.alias_counts(facts).collect()
    assert row.asDict() == {"left_key": "freight revenue", "right_key": "freight revenue net", "n": n * n - 100 * 200 * 200}


@pytest.mark.parametrize("part", [R.LINK_PAIRS, 7])
def test_bridges_are_those_of_all_pairs(spark, mixed, monkeypatch, part):
    """Also where the facts of two wordings meet in several tasks; facts without confidence make none, as in the SQL."""
    monkeypatch.setattr(R, "LINK_PAIRS", part)
    got = R.value_bridge(mixed).select("left_id", "right_id", "l_metric_key", "r_metric_key", "confidence").collect()
    assert {(a, b): tuple(rest) for a, b, *rest in got} == bridged(spark, mixed) and len(got) == len({r[:2] for r in got}) > 0


def test_votes_and_promotion_from_counts(spark):
    """Counted bridges vote and promote as made ones do."""
    from claimlake.operators import serve as S

    rows = [fact(i, doc_id="ab"[i % 2], metric_key=KEYS[i % 2], concept_id=f"c{i % 2}") for i in range(6)]
    new = R.alias_counts(spark.createDataFrame(rows, POOL))
    stored = spark.createDataFrame([(KEYS[0], KEYS[1], 1)], "left_key string, right_key string, votes int")
    assert [tuple(r) for r in S.promoted(S.alias_votes(stored, new)).select("left_key", "right_key").collect()] == [(KEYS[0], KEYS[1])]


def test_promotion_reads_facts_once_for_all_its_uses(spark):
    """Votes use the counts twice and counts use the cells many times; what is left to run reads what was counted."""
    import __spark_entry__ as entry

    files = entry.queries()["alias_promotion_coarse"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("facts.parquet" in f for f in files)


def test_facts_judged_early_are_the_facts_that_meet_the_condition(spark, tmp_path):
    """Also where copies differ: the first arrival decides, and copies of one instant are merged before they are judged."""
    from claimlake.sources import claims as T

    rows = [("once", 1, 5.0, "INR"), ("once-not", 1, 5.0, "count"), ("first-not", 1, 5.0, "count"), ("first-not", 2, 5.0, "INR"), ("later-not", 1, 5.0, "INR"), ("later-not", 2, 5.0, "count"), ("merged", 1, 0.0, "A"), ("merged", 1, 5.0, "count"), ("merged-in", 1, None, "INR"), ("merged-in", 1, 5.0, "count"), ("merged-in", 1, 7.0, "A"), ("no-unit", 1, 5.0, None), (None, 1, 5.0, "INR"), ("again", 1, 5.0, "INR"), ("again", 3, 5.0, "INR")]
    spark.createDataFrame(rows, "fact_id string, recorded_at int, value double, unit string").write.parquet(f"{tmp_path}/facts.parquet")
    condition = "unit <> 'count' and value <> 0"
    for columns in ([], ["value", "unit"]):
        got = T.facts_where(spark, str(tmp_path), F.expr(condition), *columns)
        expected = T.facts(spark, str(tmp_path), *columns).where(condition)
        assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert {r["fact_id"] for r in got.collect()} >= {"once", "later-not", "again"} and "first-not" not in {r["fact_id"] for r in got.collect()}


def test_counts_by_document_and_precision(spark):
    """Of cells that meet in a document only those pairs are taken off, one wording with itself and values that differ included."""
    r = random.Random(11)
    rows = [fact(i, doc_id=f"d{r.randrange(40)}", metric_key=r.choice(KEYS), concept_id=r.choice(["c1", "c2", None]), value=r.choice([100.0, 100.3, -100.0]), precision=r.choice([0.1, 1.0, None])) for i in range(300)]
    facts = spark.createDataFrame(rows, POOL)
    expected = Counter(tuple(sorted(keys)) for *keys, _ in bridged(spark, facts).values())
    got = {(r["left_key"], r["right_key"]): r["n"] for r in R.alias_counts(facts).collect()}
    assert got == {k: n for k, n in expected.items() if n >= R.ALIAS_VOTES}


@pytest.mark.parametrize("held", [R.HELD_CELLS, 0])
def test_counts_of_nothing_and_of_cells_that_meet_by_sorting(spark, mixed, tmp_path, monkeypatch, held):
    expected = sorted(map(tuple, R.alias_counts(mixed).collect()))
    monkeypatch.setattr(R, "HELD_CELLS", held)
    assert sorted(map(tuple, R.alias_counts(mixed).collect())) == expected
    mixed.write.parquet(f"{tmp_path}/facts")
    stored = spark.read.parquet(f"{tmp_path}/facts")
    assert R.alias_counts(mixed.where("false")).count() == R.alias_counts(stored.where("value = 1234567")).count() == 0
