"""A few keys holding most records.

Heavy keys are detected by a mergeable frequent-items sketch (one scan, no shuffle of rows), processed through a
broadcast of the few heavy keys with their rows spread over salts, while every other key takes the ordinary shuffle; the
two results are united. The sketch only routes rows: results are exact whatever it reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The sketch tracks this many counters: a key above 3.5/TRACKED (0.34 %) of the rows is always seen. Every task sends one.
TRACKED = 1_024
#: A key with at least this share of the rows is processed as heavy, so there are at most 200 heavy keys a column.
HEAVY_SHARE = 0.005
#: Parts into which the rows of one heavy key are spread.
SALTS = 64


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> dict[str, list]:
    """Keys that hold at least about ``share`` of the rows, for each column, from one scan of those columns.

    Null and empty keys are left out; keys are of one type. The estimate of a key's count is never below the truth, so no key at or above
    ``share`` is missed; at most ``1 / share`` plus the sketch's error come back, so the lists are bounded.
    """
    row = df.agg(F.count("*").alias("n"), *(sketch(F.col(k), share).alias(f"s{i}") for i, k in enumerate(keys))).first()
    return {k: heavy_of(row[f"s{i}"], row["n"], share) for i, k in enumerate(keys)}


def sketch(key: Column, share: float = HEAVY_SHARE) -> Column:
    """The aggregate behind :func:`heavy_keys`, for those who can take it while they write the rows anyway."""
    return F.call_function("approx_top_k", F.when(F.length(key.cast("string")) > 0, key), F.lit(int(2 / share)), F.lit(TRACKED))


def heavy_of(seen: list | None, n: int, share: float = HEAVY_SHARE) -> list:
    """Keys of a :func:`sketch` over ``n`` rows that hold at least about ``share`` of them."""
    return [x["item"] for x in seen or [] if x["item"] is not None and x["count"] >= share * n]


def keyed(df: DataFrame, keys: Sequence[str], *carried: str) -> DataFrame:
    """One row per row and key column: ``(key_field, key_value, *carried)``; null and empty keys are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_value")) for k in keys))
    rows = df.select(F.explode(pairs).alias("_k"), *carried)
    return rows.select("_k.key_field", "_k.key_value", *carried).where(F.length("key_value") > 0)


def aggregate_by_key(rows: DataFrame, heavy: dict[str, list], partial: Sequence[Column], final: Sequence[Column], spread: str) -> DataFrame:
    """Per-key results of ``rows(key_field, key_value, ...)`` with heavy keys apart.

    ``partial`` aggregates the rows of one key and salt, ``final`` merges the partial results; both name their outputs,
    and ``final`` reads those of ``partial``. ``spread`` is the column whose hash picks the salt, so equal values meet in
    the same salt and distinct counts of that column may be summed.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("key_field", T.StringType()), T.StructField("key_value", T.StringType())])
    few = F.broadcast(spark.createDataFrame([(k, v) for k, vs in heavy.items() for v in vs], schema))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).alias("_salt")
    hot = rows.join(few, ["key_field", "key_value"]).groupBy("key_field", "key_value", salt).agg(*partial)
    cold = rows.join(few, ["key_field", "key_value"], "left_anti").groupBy("key_field", "key_value").agg(*partial)
    names = [f for f in cold.columns]
    return hot.select(*names).groupBy("key_field", "key_value").agg(*final).unionByName(cold.groupBy("key_field", "key_value").agg(*final))


def join_by_key(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "left") -> DataFrame:
    """Equi-join on ``key`` in which rows of ``left`` with a heavy key meet a broadcast of ``right``'s rows for these keys.

    ``right`` must hold each key once, so the broadcast has at most ``len(heavy)`` rows. The other rows take the ordinary
    shuffle. ``how`` is ``left`` or ``inner``. Null keys of ``left`` match nothing and are kept by ``left``.
    """
    if not heavy:
        return left.join(right, key, how)
    hot_key = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    hot = left.where(hot_key).join(F.broadcast(right.where(hot_key)), key, how)
    cold = left.where(~hot_key).join(right.where(~hot_key), key, how)
    return hot.unionByName(cold)


def dominant_keys(facts: DataFrame, keys: Sequence[str] = ("concept_id", "subject_key"), share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of all distinct ``fact_id`` values: ``(key_field, key_value)``.

    Rows sent again count once; rows without a fact_id count for nothing. Null and empty keys are no keys. A fact whose
    copies disagree about a key counts for each. Empty input: no rows. Other columns are ignored.
    """
    return key_shares(facts, keys).where(F.col("n_facts") >= F.col("n_all") * F.lit(share)).select("key_field", "key_value")


def key_shares(facts: DataFrame, keys: Sequence[str] = ("concept_id", "subject_key")) -> DataFrame:
    """``(key_field, key_value, n_facts, n_all)``: distinct facts per key and distinct facts altogether."""
    heavy = heavy_keys(facts, keys)
    once = facts.select("fact_id", *keys).where("fact_id is not null").distinct()
    partial, final = [F.count_distinct("fact_id").alias("n_facts")], [F.sum("n_facts").alias("n_facts")]
    if len(keys) == 1:
        partial = [F.count("*").alias("n_facts")]
    counts = aggregate_by_key(keyed(once, keys, "fact_id"), heavy, partial, final, "fact_id")
    total = once.agg(F.count_distinct("fact_id").alias("n_all"))
    return counts.crossJoin(F.broadcast(total))


def key_profile(facts: DataFrame, keys: Sequence[str] = ("concept_id", "subject_key")) -> DataFrame:
    """Complete per-key results: facts, documents, first and last arrival, smallest and largest value.

    The same handling of repeats, nulls and empty input as :func:`dominant_keys`. Documents are counted exactly: heavy
    keys spread over salts by document, so a document meets itself in one salt.
    """
    heavy = heavy_keys(facts, keys)
    first = F.min(F.struct("recorded_at", "doc_id", *keys, "value")).alias("_first")
    once = facts.where("fact_id is not null").groupBy("fact_id").agg(first).select("fact_id", "_first.*")
    rows = keyed(once, keys, "doc_id", "recorded_at", "value")
    per_doc = aggregate_by_key(
        rows, heavy,
        [F.count("*").alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.min("value").alias("min_value"), F.max("value").alias("max_value")],
        [F.sum("n_facts").alias("n_facts"), F.sum("n_docs").alias("n_docs"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")],
        "doc_id",
    )
    return per_doc
