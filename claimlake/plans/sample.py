"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def smallest_hashes(df: DataFrame, key: Column, n: int, rows: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hash of ``key``, in that order.

    ``rows`` is about the number of rows: with many of them a bound on the hash first leaves some ``4 n`` rows to sort,
    so that no task gathers ``n`` rows from every partition. The sample does not depend on partitioning.
    """
    hashed = df.withColumn("_h", F.xxhash64(key))
    if rows > 8 * n:
        hashed = hashed.where(F.col("_h") < int(-(2**63) + 2**64 * (4 * n / rows)))
    return hashed.orderBy("_h").limit(n).drop("_h")
