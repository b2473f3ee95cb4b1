import pytest

import __spark_entry__ as contract
import oracle
from veilframe.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    equal, message = oracle.compare(QUERIES[name](spark, SF), tables, SQL[name])
    assert equal, message
