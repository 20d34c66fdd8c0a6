"""Every registered query against its DuckDB twin (row count, column names,
order-insensitive values) on the sf0.001 tables; ``tests/oracle_harness.py``
runs the same check at other scales."""

from __future__ import annotations

import pytest

import os
import sys

import __spark_entry__ as E
import registry

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_harness import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}
SQL = {k: v for k, v in E.oracle_sql().items() if k in registry.ORACLE}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "period_start" in df.columns
