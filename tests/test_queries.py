import pytest

from strata import registry
from tests.oracle import agree

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, tiny, name):
    agree(registry.QUERIES[name](spark, tiny), registry.ORACLE_SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() >= 0
