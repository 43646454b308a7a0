"""The claim tables as the engine reads them: each key once, in declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimlake.plans.scratch import Scratch
from claimlake.sources.tables import table


def _pick(df: DataFrame, key: str, order: str, latest: bool = False) -> DataFrame:
    """One row per key: the copy with the smallest or largest ``order``.

    Copies of one instant that differ are merged column by column, the smallest value (the largest for ``latest``) of
    each, so every run agrees. Every column is an aggregate of its own, of which Catalyst drops those nobody reads,
    down to the scan; the order travels with each.
    """
    kinds = dict(df.dtypes)
    best = F.max if latest else F.min
    by = F.max_by if latest else F.min_by

    def of(c: str) -> Column:
        if kinds[c].startswith("map"):  # maps have no order, their sorted entries have
            return by(c, F.struct(order, F.array_sort(F.map_entries(c)).alias("_e"))).alias(c)
        return best(F.struct(order, F.col(c).alias("_c")))["_c"].alias(c)

    rest = [of(c) for c in df.columns if c not in (key, order)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best(order).alias(order), *rest).select(*df.columns)


def facts(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Facts by ``fact_id``; rows sent again count once, with their first arrival."""
    wanted = dict.fromkeys(["fact_id", "recorded_at", *columns]) if columns else []
    return _pick(table(spark, root, "facts", *wanted), "fact_id", "recorded_at", latest=False)


def facts_where(spark: SparkSession, root: str, condition: Column, *columns: str) -> DataFrame:
    """:func:`facts` that meet ``condition``; a row whose id stands once is judged before it is moved, and moved no further.

    Only rows of ids that repeat are brought together. Hashes of ids tell them, where one too many costs time alone.
    """
    wanted = dict.fromkeys(["fact_id", "recorded_at", *columns]) if columns else []
    rows = table(spark, root, "facts", *wanted).where("fact_id is not null")
    code = F.xxhash64("fact_id").alias("code")
    _, again = Scratch(spark, "repeated").write(rows.select(code).groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code"))
    of = lambda how: rows.select("*", code).join(again, "code", how).drop("code")
    return of("left_anti").unionByName(_pick(of("left_semi"), "fact_id", "recorded_at", latest=False)).where(condition)


def relations(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Relations by ``relation_id``, kinds in lower case without outer blanks; rows without a side are left out."""
    wanted = dict.fromkeys(["relation_id", "recorded_at", "left_id", "right_id", "relation", *columns]) if columns else []
    once = _pick(table(spark, root, "relations", *wanted), "relation_id", "recorded_at", latest=False)
    return once.withColumn("relation", F.lower(F.trim("relation"))).where("left_id is not null and right_id is not null")


def documents(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Source documents by ``doc_id``; the latest load replaces earlier ones."""
    wanted = dict.fromkeys(["doc_id", "ingested_at", *columns]) if columns else []
    return _pick(table(spark, root, "source_documents", *wanted), "doc_id", "ingested_at", latest=True)


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages by document and number; repeated rows count once, of those that differ the smallest values."""
    df = table(spark, root, "pages")
    smallest = [F.min(c).alias(c) for c in df.columns if c not in ("doc_id", "page_no")]
    return df.groupBy("doc_id", "page_no").agg(*smallest).select(*df.columns)


def concepts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "concepts")
