import pytest

from seamark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(name, spark, sf, duck, rows):
    columns, own = rows(registry.queries()[name](spark, sf))
    assert own == duck(registry.oracle_sql()[name], sf, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    found = registry.queries()[name](spark, sf)
    assert found.count() > 0 or name in ("op2_license_scan",)
