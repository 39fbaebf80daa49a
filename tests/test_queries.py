"""Every registered query against its SQL on the small tables; those without SQL must run and have rows."""

import pytest

from ledgerlens.plans import catalogue
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLE_SQL:
        same(got, duck.execute(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_contract(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["id", "fraud"]
