"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

from ruleflow.queries import ORACLES, QUERIES
from tests.oracle import differences, expected

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    actual = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(actual, expected(SF_DIR, ORACLES[name])) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
