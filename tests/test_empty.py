"""Every query on empty tables gives what its SQL gives there."""

import pyarrow.parquet as pq
import pytest

from tests.oracle import TABLES, connect, rows_of, rows_of_sql
from tradewind.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        pq.write_table(pq.read_schema(f"{SF}/{t}.parquet").empty_table(), f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(q for q in catalogue.QUERIES if not q.startswith("st_")))
def test_empty(spark, empty, name):
    cols, rows = rows_of(catalogue.QUERIES[name](spark, empty))
    if name in catalogue.ORACLE:
        assert (cols, rows) == rows_of_sql(connect(empty), catalogue.ORACLE[name])
