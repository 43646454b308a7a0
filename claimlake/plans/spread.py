"""Spreading CPU-heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, before a kernel that costs far more than moving its input.

    Tables of enough splits, as on a cluster, are left as they are; only a scan of few splits (a small table in one file)
    is shuffled. Pass scans: the partitions of a plan with a shuffle are not known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores, *keys)
