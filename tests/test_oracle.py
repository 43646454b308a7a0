"""Every query with SQL against that SQL on the smallest scale."""

from __future__ import annotations

import pytest
from oracle import compare

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, name, ROOT)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
