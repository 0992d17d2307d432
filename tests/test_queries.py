"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tradewind.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    cols, rows = rows_of(catalogue.QUERIES[name](spark, SF))
    assert len(cols) == len(set(cols))
    if name in catalogue.ORACLE:
        assert (cols, rows) == rows_of_sql(duck, catalogue.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
