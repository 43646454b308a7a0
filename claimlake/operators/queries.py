"""Queries over the general problems, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlake.operators import references, skew, unify
from claimlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _unified(spark: SparkSession, root: str) -> DataFrame:
    facts = table(spark, root, "facts", "fact_id", "recorded_at", "doc_id", "page_no", "value_start", "display", "value", "unit", "metric_key", "precision", "evidence", "char_start")
    quantities = table(spark, root, "quantities", "quantity_id", "doc_id", "page_no", "value_start", "raw", "value", "unit", "precision", "unit_context")
    return unify.unify(facts, quantities, table(spark, root, "pages", "doc_id", "page_no", "text"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return unify.not_in_base(_unified(spark, root))


def p2_routes(spark: SparkSession, root: str) -> DataFrame:
    return _unified(spark, root).groupBy("record_table", "base_unit", "route").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return skew.dominant_keys(table(spark, root, "facts"))


def p4_key_profile(spark: SparkSession, root: str) -> DataFrame:
    return skew.key_profile(table(spark, root, "facts"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return references.claim_orphans(*(table(spark, root, t) for t in ("relations", "facts", "source_documents", "concepts")))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_report(p5_found(spark, root))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_routes, p4_found, p4_key_profile, p5_found, p5_report)}


P5 = """
  WITH f AS (SELECT fact_id, min(recorded_at) seen_at, any_value(doc_id) doc_id, any_value(concept_id) concept_id FROM facts WHERE fact_id IS NOT NULL GROUP BY 1),
  r AS (SELECT relation_id, min(recorded_at) seen_at, any_value(left_id) left_id, any_value(right_id) right_id FROM relations WHERE relation_id IS NOT NULL GROUP BY 1),
  refs AS (
    SELECT 'relations.left_id' ref_field, relation_id row_id, seen_at, left_id k FROM r
    UNION ALL SELECT 'relations.right_id', relation_id, seen_at, right_id FROM r
    UNION ALL SELECT 'facts.doc_id', fact_id, seen_at, doc_id FROM f
    UNION ALL SELECT 'facts.concept_id', fact_id, seen_at, concept_id FROM f),
  parents AS (
    SELECT 'fact' t, fact_id k, seen_at arrived, false deleted FROM f
    UNION ALL SELECT 'doc', doc_id, min(ingested_at), arg_max(deleted_at IS NOT NULL, ingested_at) FROM source_documents GROUP BY doc_id
    UNION ALL SELECT 'concept', concept_id, min(recorded_at), arg_max(deleted_at IS NOT NULL, recorded_at) FROM concepts GROUP BY concept_id),
  judged AS (
    SELECT ref_field, row_id, strftime(seen_at, '%Y-%m') ref_period,
      CASE WHEN p.k IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN arrived > seen_at THEN 'late' END reason
    FROM refs LEFT JOIN parents p ON p.k = refs.k AND p.t = CASE ref_field WHEN 'facts.doc_id' THEN 'doc' WHEN 'facts.concept_id' THEN 'concept' ELSE 'fact' END
    WHERE refs.k <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
          WITH k AS (
            SELECT 'concept_id' key_field, concept_id key_value, fact_id FROM facts
            UNION ALL SELECT 'subject_key', subject_key, fact_id FROM facts)
          SELECT key_field, key_value FROM k WHERE key_value <> '' GROUP BY 1, 2
          HAVING count(DISTINCT fact_id) >= 0.02 * (SELECT count(DISTINCT fact_id) FROM facts)""",
        "p4_key_profile": """
          WITH f AS (SELECT fact_id, min(recorded_at) recorded_at, any_value(doc_id) doc_id, any_value(concept_id) concept_id, any_value(subject_key) subject_key, any_value("value") v
            FROM facts WHERE fact_id IS NOT NULL GROUP BY 1),
          k AS (SELECT 'concept_id' key_field, concept_id key_value, * FROM f UNION ALL SELECT 'subject_key', subject_key, * FROM f)
          SELECT key_field, key_value, count(*) n_facts, count(DISTINCT doc_id) n_docs, min(recorded_at) first_at, max(recorded_at) last_at, min(v) min_value, max(v) max_value
          FROM k WHERE key_value <> '' GROUP BY 1, 2""",
        "p5_found": P5 + " SELECT * FROM judged WHERE reason IS NOT NULL",
        "p5_report": P5 + " SELECT ref_field, ref_period, reason, count(*) n FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    }
