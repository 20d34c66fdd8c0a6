"""The registered training-data queries: their DuckDB twins where SQL can
express them, and full results of the others, on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

import __spark_entry__ as E
from loadgrid.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_harness import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, E.queries()[name], queries.ORACLE[name], SF)
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_covers_its_table(spark, name):
    df = E.queries()[name](spark, SF)
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    if name == "op6_token_output":
        got = {d for r in df.select("doc_ids").collect() for d in r[0]}
    else:
        got = {r[0] for r in df.select("doc_id").collect()}
    assert got == set(ids)
