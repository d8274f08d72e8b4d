import pytest

from lexigrove.llm import registry

from ..oracle import DATA, database, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    out = registry.queries()[name](spark, DATA).toPandas()
    want = database().execute(registry.oracle_sql()[name]).df()
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out) == rows(want)
