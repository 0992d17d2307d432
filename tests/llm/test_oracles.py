"""Queries of this subpackage that have SQL, against it on the smallest tables and on empty ones."""

import pyarrow.parquet as pq
import pytest

from tests.oracle import TABLES, connect, rows_of, rows_of_sql
from tradewind.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name, tmp_path):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), ORACLE[name])
    for t in TABLES:
        pq.write_table(pq.read_schema(f"{SF}/{t}.parquet").empty_table(), f"{tmp_path}/{t}.parquet")
    assert rows_of(QUERIES[name](spark, str(tmp_path))) == rows_of_sql(connect(str(tmp_path)), ORACLE[name])
