import oracle
import pytest

import __spark_entry__ as entry
from feedlake.plans import driver_queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(driver_queries.QUERIES) == set(driver_queries.ORACLE_SQL)


@pytest.mark.parametrize("name", list(driver_queries.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    sql = entry.oracle_sql()[name]
    assert oracle.differences(spark, con, entry.queries()[name], sql, SF_DIR) is None


def test_entry(spark):
    ranked = entry.entry(spark)
    assert ranked.columns == ["source", "count"] and ranked.count() == 20
