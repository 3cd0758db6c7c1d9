import pytest

from ruleflow.llm.queries import ORACLES, QUERIES
from tests.oracle import differences, expected

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR).toPandas(), expected(SF_DIR, ORACLES[name])) is None


def test_every_operator_has_one_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
