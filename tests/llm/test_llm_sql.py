"""Queries with SQL, on whole tables."""

import pytest

import oracle
from veilframe.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    equal, message = oracle.compare(QUERIES[name](spark, SF), tables, SQL[name])
    assert equal, message
