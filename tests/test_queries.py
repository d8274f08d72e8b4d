import pytest

import __spark_entry__
from lexigrove.plans import registry

from .oracle import DATA, database, rows

CON = database()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    out = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(out) > 0
        return
    want = CON.execute(sql).df()
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out) == rows(want)
