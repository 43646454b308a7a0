"""Lineage cuts that survive the loss of executors.

A written table in the folder that ``spark.checkpoint.dir`` names is visible to every executor, columnar and
compressed, so it serves better than RDD checkpoints for frames that are read again. Where the setting is absent (local
tests) a temporary folder of this machine is used, which is safe only because such a session runs in one JVM.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one only where the session runs in a single JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='claimlake-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Intermediate tables of one run below the shared folder.

    Superseded tables are removed with :meth:`drop`; what a result still reads stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clear)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop(self.root)

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Write ``df`` and return its path and a frame that reads it back without the old lineage."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def write_observing(self, df: DataFrame, **wanted: Column) -> tuple[str, DataFrame, dict]:
        """As :meth:`write`, and aggregates of the rows, taken while writing."""
        seen = Observation()
        path, back = self.write(df.observe(seen, *(c.alias(k) for k, c in wanted.items())))
        return path, back, seen.get

    def write_counting(self, df: DataFrame, condition: str = "true") -> tuple[str, DataFrame, int]:
        """As :meth:`write`, and the number of rows that meet ``condition``, taken while writing."""
        path, back, seen = self.write_observing(df, n=F.count_if(F.expr(condition)))
        return path, back, seen["n"]

    def drop(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            where = jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(conf).delete(where, True)
