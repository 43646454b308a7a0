"""Concepts: groups of metric wordings induced from the corpus's own statistics."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from claimlake.plans.scratch import Scratch

#: A wording joins the concept whose central wording is at least this alike.
JOINS = 0.62
LEAST_KEYS = 4


def token_frequency(keys: DataFrame) -> DataFrame:
    """``(token, df)``: distinct metric keys that hold each word. ``keys(metric_key)`` must be distinct."""
    words = keys.where(F.length("metric_key") > 0).select(F.explode(F.array_distinct(F.split("metric_key", " "))).alias("token"))
    return words.where(F.length("token") > 0).groupBy("token").agg(F.count("*").alias("df"))


def idf(n_keys: Column, df: Column) -> Column:
    return F.log(F.greatest(n_keys, F.lit(LEAST_KEYS)) / (df + 1)) + 1.0


def token_idf(keys: DataFrame) -> DataFrame:
    """``(token, df, idf)``."""
    n = keys.where(F.length("metric_key") > 0).agg(F.count("*").alias("n_keys"))
    return token_frequency(keys).crossJoin(F.broadcast(n)).select("token", "df", idf(F.col("n_keys"), F.col("df")).alias("idf"))


def weighted_keys(keys: DataFrame) -> DataFrame:
    """``(key, weights map<token, idf squared>, norm)`` of distinct ``keys(metric_key)``."""
    weights = token_idf(keys).select("token", (F.col("idf") * F.col("idf")).alias("w"))
    words = keys.where(F.length("metric_key") > 0).select(F.col("metric_key").alias("key"), F.explode(F.array_distinct(F.split("metric_key", " "))).alias("token"))
    grouped = words.join(weights, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("tw"))
    total = F.aggregate("tw", F.lit(0.0), lambda acc, x: acc + x["w"])
    return grouped.select("key", F.map_from_entries("tw").alias("weights"), total.alias("norm"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """``(left_key, right_key, score)``, left before right, of distinct keys that share a word: an equi-join on words.

    A word that many keys share makes many pairs; keys are distinct wordings, whose number grows far slower than facts.
    """
    weights = token_idf(keys).select("token", (F.col("idf") * F.col("idf")).alias("w"))
    words = keys.where(F.length("metric_key") > 0).select("metric_key", F.explode(F.array_distinct(F.split("metric_key", " "))).alias("token")).join(weights, "token")
    norm = words.groupBy("metric_key").agg(F.sum("w").alias("norm"))
    a = words.select("token", "w", F.col("metric_key").alias("left_key"))
    b = words.select("token", F.col("metric_key").alias("right_key"))
    dots = a.join(b, "token").where("left_key < right_key").groupBy("left_key", "right_key").agg(F.sum("w").alias("dot"))
    full = dots.join(norm.select(F.col("metric_key").alias("left_key"), F.col("norm").alias("ln")), "left_key").join(norm.select(F.col("metric_key").alias("right_key"), F.col("norm").alias("rn")), "right_key")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    bonus = F.when(last(F.col("left_key")) == last(F.col("right_key")), 0.05).otherwise(0.0)
    return full.select("left_key", "right_key", F.least(F.col("dot") / F.sqrt(F.col("ln") * F.col("rn")) + bonus, F.lit(1.0)).alias("score"))


def concept_id(key: str) -> str:
    return "c" + hashlib.sha1(key.encode()).hexdigest()[:10]


class Clusters:
    """Leader clustering of wordings in a given order.

    A wording joins the concept whose central wording (its most used one, the earliest of ties) is most alike, the
    lowest id of ties; below JOINS it founds a concept. The result depends on the order, which callers must fix.
    """

    def __init__(self, frequency: dict[str, int], n_keys: int):
        total = max(n_keys, LEAST_KEYS)
        self.weight = {t: (math.log(total / (1 + df)) + 1.0) ** 2 for t, df in frequency.items()}
        self.rare = (math.log(total) + 1.0) ** 2
        self.of_key: dict[str, str] = {}
        self.uses: dict[str, Counter] = defaultdict(Counter)  # concept -> key -> uses
        self.surfaces: dict[str, Counter] = defaultdict(Counter)  # key -> surface -> uses
        self.centre: dict[str, str] = {}
        self.holding: dict[str, set[str]] = defaultdict(set)  # token -> concepts whose centre has held it

    def alike(self, left: str, right: str) -> float:
        a, b = set(left.split()), set(right.split())
        shared = a & b
        if not shared:
            return 0.0
        size = lambda s: sum(self.weight.get(t, self.rare) for t in sorted(s))
        score = size(shared) / math.sqrt(size(a) * size(b))
        return min(1.0, score + 0.05 * (left.split()[-1] == right.split()[-1]))

    def assign(self, key: str, surface: str, uses: int = 1) -> str:
        key = key or surface.lower()
        found = self.of_key.get(key)
        if found is None:
            near = sorted({c for t in key.split() for c in self.holding[t]})
            best = max(near, key=lambda c: (self.alike(key, self.centre[c]), [-ord(x) for x in c]), default=None)
            found = best if best and self.alike(key, self.centre[best]) >= JOINS else concept_id(key)
            self.of_key[key] = found
        self.uses[found][key] += uses
        self.surfaces[key][surface] += uses
        self.centre[found] = max(self.uses[found], key=self.uses[found].__getitem__)
        for t in self.centre[found].split():
            self.holding[t].add(found)
        return found


def wordings(facts: DataFrame) -> DataFrame:
    """``(metric_key, metric, uses, at, id)``: every distinct wording and surface, its uses and first appearance."""
    rows = facts.where(F.length("metric_key") > 0).groupBy("metric_key", "metric").agg(F.count("*").alias("uses"), F.min(F.struct("recorded_at", "fact_id")).alias("first"))
    return rows.select("metric_key", "metric", "uses", F.col("first.recorded_at").alias("at"), F.col("first.fact_id").alias("id"))


def add_wordings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored wordings, whose ``concept_id`` stays, with those of new facts added."""
    both = stored.unionByName(new.withColumn("concept_id", F.lit(None).cast("string")))
    rows = both.groupBy("metric_key", "metric").agg(F.sum("uses").alias("uses"), F.min(F.struct("at", "id")).alias("first"), F.max("concept_id").alias("concept_id"))
    return rows.select("metric_key", "metric", "uses", F.col("first.at").alias("at"), F.col("first.id").alias("id"), "concept_id")


def assign_concepts(facts: DataFrame) -> DataFrame:
    """``(metric_key, concept_id, canonical_key, label)`` of every distinct wording of ``facts``; see :func:`fold_concepts`."""
    return fold_concepts(wordings(facts).withColumn("concept_id", F.lit(None).cast("string")))


def fold_concepts(rows: DataFrame) -> DataFrame:
    """Concepts of ``rows(metric_key, metric, uses, at, id, concept_id)``: ``(metric_key, concept_id, canonical_key, label)``.

    Wordings are assigned in the order of their first appearance (arrival, then id); those that have a concept keep it.
    The fold runs in one task over the distinct wordings and their surfaces, never over facts; wordings without words
    are left out.
    """
    folded = rows.withColumn("one", F.lit(0))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id", "metric"], kind="stable")
        keys = list(dict.fromkeys(pdf["metric_key"]))
        frequency = Counter(t for k in keys for t in set(k.split()))
        clusters = Clusters(frequency, len(keys))
        clusters.of_key |= {k: c for k, c in zip(pdf["metric_key"], pdf["concept_id"]) if isinstance(c, str)}
        for key, surface, uses in zip(pdf["metric_key"], pdf["metric"], pdf["uses"]):
            clusters.assign(key, surface or key, int(uses))
        label = {k: max(c, key=c.__getitem__) for k, c in clusters.surfaces.items()}
        out = [(k, c, clusters.centre[c], label[clusters.centre[c]]) for k, c in clusters.of_key.items()]
        return pd.DataFrame(out, columns=["metric_key", "concept_id", "canonical_key", "label"])

    return folded.groupBy("one").applyInPandas(fold, "metric_key string, concept_id string, canonical_key string, label string")


def merge_concepts(assigned: DataFrame, aliases: DataFrame) -> DataFrame:
    """Fuse concepts that promoted aliases ``(left_key, right_key)`` tie, chains included: ``(concept_id, merged_id)``.

    The smallest id of the tied concepts stays. Ties among distinct concepts are few; rounds end when no label changes.
    """
    of = assigned.select("metric_key", "concept_id")
    edges = aliases.join(of.select(F.col("metric_key").alias("left_key"), F.col("concept_id").alias("a")), "left_key").join(of.select(F.col("metric_key").alias("right_key"), F.col("concept_id").alias("b")), "right_key").select("a", "b").where("a <> b")
    scratch = Scratch(assigned.sparkSession, "merge")
    _, edges = scratch.write(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"))
    labels = assigned.select("concept_id").distinct().select("concept_id", F.col("concept_id").alias("merged_id"))
    changed = 1
    while changed:
        near = edges.join(labels, F.col("b") == F.col("concept_id")).groupBy("a").agg(F.min("merged_id").alias("near"))
        moved = labels.join(near, F.col("concept_id") == F.col("a"), "left").select("concept_id", F.least("merged_id", F.coalesce("near", "merged_id")).alias("new"), "merged_id")
        _, moved, changed = scratch.write_counting(moved, "new <> merged_id")
        labels = moved.select("concept_id", F.col("new").alias("merged_id"))
    return labels
