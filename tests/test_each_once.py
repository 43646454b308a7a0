"""Kernels read equal rows of a batch once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from claimlake.functions import udfs as U


def test_equal_texts_are_read_once():
    read = []
    got = U.each_once(lambda t: read.append(t) or [t or ""], T.ArrayType(T.StringType()), pa.array(["a", None, "a", "b", None]))
    assert got.to_pylist() == [["a"], [""], ["a"], ["b"], [""]] and len(read) == 3


def test_quantities_of_equal_and_null_texts(spark):
    df = spark.createDataFrame([(1, "It cost US$ 5,000."), (2, None), (3, "It cost US$ 5,000."), (4, "")], "id int, t string")
    got = {r["id"]: [(q["unit"], q["value"]) for q in r["q"]] for r in df.select("id", U.find_quantities("t").alias("q")).collect()}
    assert got == {1: [("USD", 5000.0)], 2: [], 3: [("USD", 5000.0)], 4: []}


def test_equal_tables_are_read_once():
    """Rows of lists and nulls, as the tables of caption_recovery and header_context are."""
    read = []
    heads, stubs, below = pa.array([["a", "b"], ["a", "b"], ["a", "c"]]), pa.array(["x", "x", "x"]), pa.array([None, None, ["k", "l"]], pa.list_(pa.string()))
    got = U.each_once(lambda *k: read.append(k) or len(read), T.IntegerType(), heads, stubs, below)
    assert got.to_pylist() == [1, 1, 2] and read == [(("a", "b"), "x", None), (("a", "c"), "x", ("k", "l"))]
