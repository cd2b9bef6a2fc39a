"""Every core query with SQL gives what DuckDB gives on the same tables; those without run."""

import pytest

from sievelake.plans import registry
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    registry.QUERIES[name](spark, SF).collect()
