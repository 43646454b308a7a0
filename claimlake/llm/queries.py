"""Queries over the training-data problems, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlake.llm import areas, components, leakage, packing, sentences
from claimlake.sources.tables import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return components.consolidate(table(spark, root, "relations", "left_id", "right_id", "relation"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    page = F.concat_ws("#", "doc_id", F.col("page_no").cast("string"))
    whole = F.when(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull(), page)
    pages = sentences.split_sentences(table(spark, root, "pages", "doc_id", "page_no", "text"), whole, "text", "pages.text")
    evidence = table(spark, root, "facts", "fact_id", "evidence")
    return pages.unionByName(sentences.split_sentences(evidence, F.col("fact_id"), "evidence", "facts.evidence", least=2))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents", "doc_id", "text")
    return packing.fill_containers(packing.count_tokens(documents, TOKENIZERS), n_documents=documents.count())


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.container_report(p6_containers(spark, root))


def p6_breaches(spark: SparkSession, root: str) -> DataFrame:
    """What no placement may have, counted over all documents."""
    return packing.breaches(p6_containers(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text"))


def p7_kept(spark: SparkSession, root: str) -> DataFrame:
    """Documents that remain after those with leaked items are removed."""
    documents = table(spark, root, "documents", "doc_id", "source")
    return documents.join(p7_found(spark, root).select("doc_id").distinct(), "doc_id", "left_anti")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return areas.label_documents(table(spark, root, "documents", "doc_id", "text", "source"), table(spark, root, "area_examples", "area", "text"))


def p8_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents of each area."""
    return p8_found(spark, root).groupBy("area").agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p3_found, p6_containers, p6_report, p6_breaches, p7_found, p7_kept, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    """SQL for groups; the other problems have none and are tested against brute force, round trips and held-out texts."""
    return {
        "p6_breaches": "SELECT count(*) n_docs, 0 over_full, 0 split_in_vain, 0 with_gaps FROM documents WHERE length(text) > 0",
        "p1_found": """
          WITH RECURSIVE m AS (
            SELECT left_id a, right_id b FROM relations
            WHERE lower(trim(relation)) = 'corroborates' AND length(trim(left_id)) > 0 AND length(trim(right_id)) > 0),
          e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
          r AS (SELECT a id, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b)
          SELECT id fact_id, min(label) group_id FROM r GROUP BY 1""",
    }
