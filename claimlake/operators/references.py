"""References to records that do not exist.

Parent keys are read as integers, sorted, and compressed into runs of consecutive integers that share their attributes;
each key that is named is matched as-of to the run that starts at or before it and is an orphan when it lies beyond that
run's end. Integers are cut into blocks of consecutive values: a run never crosses a block, so one hash shuffle on the
block brings a key and its only possible run together, and no block holds more than ``BLOCK`` parents or keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimlake.operators.skew import heavy_keys, join_by_key
from claimlake.plans.scratch import Scratch
from claimlake.sources.tables import first_arrival

#: Consecutive integers a block covers.
BLOCK = 1 << 8


@dataclass(frozen=True)
class Parents:
    """Keys that may be named, as runs in the shared folder and, for keys in another spelling, as they are."""

    runs: DataFrame  # block, n, run_end, arrived, deleted
    odd: DataFrame  # key, arrived, deleted
    digits: int
    prefix: str


def key_number(key: Column, prefix: str, digits: int) -> Column:
    """The integer a key of ``digits`` hexadecimal digits after ``prefix`` stands for; null for any other spelling.

    16 digits exceed a signed long, so the two halves are read apart; the order of integers is that of the keys except
    that keys from ``8000000000000000`` on come first, which as-of matching does not mind.
    """
    body = F.substring(key, len(prefix) + 1, digits)
    high = F.conv(F.substring(body, 1, max(digits - 8, 1)), 16, 10).cast("long")
    low = F.conv(F.substring(body, max(digits - 8, 1) + 1, 8), 16, 10).cast("long")
    number = F.shiftleft(high, 32 if digits > 8 else 4 * (digits - 1)).bitwiseOR(low)
    return F.when(key.rlike(f"^{prefix}[0-9a-f]{{{digits}}}$"), number)


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.shiftright("n", BLOCK.bit_length() - 1))


def parent_runs(parents: DataFrame) -> DataFrame:
    """Compress ``parents(n, arrived, deleted)``, one row per integer, into runs ``(block, n, run_end, arrived, deleted)``.

    A run is a maximal series of consecutive integers of one block with the same arrival and deletion mark.
    """
    w = Window.partitionBy("block").orderBy("n")
    same = (F.lag("n").over(w) == F.col("n") - 1) & F.lag("arrived").over(w).eqNullSafe(F.col("arrived")) & (F.lag("deleted").over(w) == F.col("deleted"))
    started = _blocked(parents).withColumn("opens", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = started.withColumn("run", F.sum("opens").over(w))
    return numbered.groupBy("block", "run").agg(F.min("n").alias("n"), F.max("n").alias("run_end"), F.first("arrived").alias("arrived"), F.first("deleted").alias("deleted")).drop("run")


def _verdict(found: Column, deleted: Column, arrived: Column, at: Column) -> Column:
    return F.when(~found, "missing").when(deleted, "deleted").when(arrived > at, "late")


def _asof(numbers: DataFrame, runs: DataFrame) -> DataFrame:
    """``numbers(n)``, each once, with ``(found, arrived, deleted)`` of the run that starts at or before it in its block."""
    refs = _blocked(numbers).select("block", "n", F.lit(1).alias("side"))
    both = runs.select("block", "n", F.lit(0).alias("side"), "run_end", "arrived", "deleted").unionByName(refs, allowMissingColumns=True)
    before = Window.partitionBy("block").orderBy("n", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("run", F.last(F.when(F.col("side") == 0, F.struct("run_end", "arrived", "deleted")), ignorenulls=True).over(before))
    inside = F.coalesce(F.col("n") <= F.col("run.run_end"), F.lit(False))
    return carried.where("side = 1").select("n", inside.alias("found"), F.col("run.arrived").alias("arrived"), F.col("run.deleted").alias("deleted"))


def index_parents(parents: DataFrame, digits: int, prefix: str = "") -> Parents:
    """Compress ``parents(key, arrived, deleted)`` (:func:`known`) and write the runs where all references can read them."""
    numbered = parents.withColumn("n", key_number(F.col("key"), prefix, digits))
    runs = parent_runs(numbered.where("n is not null").select("n", "arrived", "deleted"))
    _, written = Scratch(parents.sparkSession, "runs").write(runs)
    return Parents(written, numbered.where("n is null").drop("n"), digits, prefix)


def orphans(refs: DataFrame, parents: Parents) -> DataFrame:
    """``(ref_field, row_id, ref_period, reason)`` of every reference to what is missing, deleted or came later.

    ``refs(ref_field, row_id, at, ref)`` may hold several fields that name the same table. It is read three times: for
    a sketch of hot keys, for the distinct keys and for the rows.

    * A null or empty reference is none. Keys in another spelling than the parent's integers are matched by an exact
      join, so nothing is lost to the integer form.
    * ``missing`` goes before ``deleted``, that before ``late``; a reference at the instant of arrival is not late. A
      row without a time is in no period (null) and never late.
    * Repeated rows must have been reduced before (:func:`claimlake.sources.tables.first_arrival`); empty parents make
      every reference missing; empty references give no rows. A row_id appears once per field.

    Skew: every key is matched as-of once, however many rows name it: keys are made distinct with partial aggregation,
    so the windows hold at most ``BLOCK`` keys and ``BLOCK`` runs. What was found goes back to the rows by key, where
    the keys that many rows name (found by a sketch, at most 400) meet a broadcast.
    """
    rows = refs.where(F.length("ref") > 0).withColumn("n", key_number(F.col("ref"), parents.prefix, parents.digits))
    whole = rows.where("n is not null").select("ref_field", "row_id", "at", "n")
    _, matched = Scratch(refs.sparkSession, "matched").write(_asof(whole.select("n").distinct(), parents.runs))
    judged = join_by_key(whole, matched, "n", heavy_keys(whole, ["n"])["n"], "inner")
    odd = parents.odd.withColumnRenamed("key", "ref").withColumn("found", F.lit(True))
    other = rows.where("n is null").join(odd, "ref", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    columns = ["ref_field", "row_id", "at", "found", "arrived", "deleted"]
    every = judged.select(*columns).unionByName(other.select(*columns))
    every = every.withColumn("reason", _verdict(F.col("found"), F.col("deleted"), F.col("arrived"), F.col("at"))).where("reason is not null")
    return every.select("ref_field", "row_id", F.date_format("at", "yyyy-MM").alias("ref_period"), "reason")


def known(df: DataFrame, key: str, arrived: str, deleted: str | None = None) -> DataFrame:
    """Parents ``(key, arrived, deleted)``: earliest arrival, and whether the latest load is marked deleted.

    Loads at the same instant: a deletion mark wins. Null and empty keys are dropped.
    """
    marked = F.col(deleted).isNotNull() if deleted else F.lit(False)
    last = F.max(F.struct(F.col(arrived).alias("_t"), marked.alias("_d")))
    some = df.where(F.length(key) > 0).groupBy(F.col(key).alias("key"))
    return some.agg(F.min(arrived).alias("arrived"), last["_d"].alias("deleted"))


def claim_orphans(relations: DataFrame, facts: DataFrame, documents: DataFrame, concepts: DataFrame) -> DataFrame:
    """Orphan references among the four tables; see :func:`orphans`. Rows sent again count once, at their first arrival.

    Jobs run while the plan is built: runs of parents and the rows of references are written, and hot keys sketched.
    """
    scratch = Scratch(relations.sparkSession, "references")
    to_facts = index_parents(known(facts, "fact_id", "recorded_at"), 16)
    to_documents = index_parents(known(documents, "doc_id", "ingested_at", "deleted_at"), 12)
    to_concepts = index_parents(known(concepts, "concept_id", "recorded_at", "deleted_at"), 10, "c")
    _, links = scratch.write(first_arrival(relations, "relation_id", "recorded_at", "left_id", "right_id"))
    _, claims = scratch.write(first_arrival(facts, "fact_id", "recorded_at", "doc_id", "concept_id"))

    def refs(rows: DataFrame, row_id: str, of: str, *fields: str) -> DataFrame:
        named = F.array(*(F.struct(F.lit(f"{of}.{f}").alias("ref_field"), F.col(f).alias("ref")) for f in fields))
        return rows.select(F.col(row_id).alias("row_id"), F.col("recorded_at").alias("at"), F.inline(named))

    found = orphans(refs(links, "relation_id", "relations", "left_id", "right_id"), to_facts)
    found = found.unionByName(orphans(refs(claims, "fact_id", "facts", "doc_id"), to_documents))
    return found.unionByName(orphans(refs(claims, "fact_id", "facts", "concept_id"), to_concepts))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per reference field, month and reason: ``(ref_field, ref_period, reason, n)``."""
    return found.groupBy("ref_field", "ref_period", "reason").agg(F.count("*").alias("n"))
