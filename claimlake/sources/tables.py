"""Table scans.

Every table is one parquet file or one directory of parquet files below a root. Scans are lazy; column pruning and
filters reach the parquet reader because nothing here touches rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Scan ``root/name.parquet``, narrowed to ``columns`` when given."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_arrival(df: DataFrame, key: str, arrived: str, *carried: str) -> DataFrame:
    """One row per ``key``: the copy that arrived first, with ``carried`` columns of that copy.

    Rows sent again count once. Null keys are dropped: a row without a key names nothing. Of copies that arrived at
    the same instant the one with the smallest carried values wins, so reruns agree. Partial aggregation runs before
    the shuffle.
    """
    from pyspark.sql import functions as F

    first = F.min(F.struct(arrived, *carried)).alias("_first")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "_first.*")
