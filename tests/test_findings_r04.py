"""What the fourth round of findings found: what is dealt and written for the findings and the order fact."""

import random
import shutil

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import rows_of, rows_of_sql
from tradewind.operators import issues, ordered
from tradewind.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_single_identities_are_not_compared_whole(spark):
    rows = [(f"i{i}", "b", str(i)) for i in range(200)] + [(None, "b", "2"), (None, None, "9"), (None, None, "9"), ("x", "b", "4"), ("x", "a", "5"), ("x", "b", None)]
    df = spark.createDataFrame(rows, "id string, business_id string, order_id string").repartition(5)
    found = issues.repeated(df, "id", "c", "s")
    # nulls: first (null, 9), beyond it the same again and (b, 2); x: first (a, 5)
    assert sorted(((r.business_id, r.order_id, r.n) for r in found.collect()), key=repr) == sorted([(None, "9", 1), ("b", "2", 1), ("b", "4", 1), ("b", None, 1)], key=repr)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_missing_counts_rows_before_they_are_dealt(spark):
    rows = [("a", 1)] * 3 + [(None, 2)] * 2 + [(None, None), ("b", None), ("a", 5)]
    child = spark.createDataFrame(rows, "business_id string, order_id long")
    parent = spark.createDataFrame([("a", 5), (None, None), ("a", 2), ("b", 1)], "business_id string, order_id long")
    found = issues.missing(child, ["business_id", "order_id"], parent, "c", "s").collect()
    assert sorted(((r.business_id, r.order_id, r.n) for r in found), key=repr) == sorted([("a", "1", 3), (None, "2", 2), ("b", None, 1)], key=repr)


@pytest.mark.parametrize("long", [3, 10**6])
def test_previous(spark, monkeypatch, long):
    """Histories cut into pieces and those that aren't give what a window gives."""
    monkeypatch.setattr(ordered, "LONG", long)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), i, rng.choice(["x", "y", None])) for i in range(40)] + [("lone", 1, 0, "x")]
    df = spark.createDataFrame(rows, "k string, l int, i int, v string").repartition(3)
    wanted = df.withColumn("p", F.last("v", ignorenulls=True).over(Window.partitionBy("k", "l").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(repr, ordered.previous(df, ["k", "l"], ["i"], "v", "p").collect())) == sorted(map(repr, wanted.collect()))


def test_short_histories_are_not_written(spark, monkeypatch):
    labels, real = [], ordered.landed
    monkeypatch.setattr(ordered, "landed", lambda df, label: (labels.append(label), real(df, label))[1])
    catalogue.QUERIES["dq_operations_findings"](spark, SF)
    assert labels == ["long-keys"]


@pytest.mark.parametrize("name", ["eco_orders", "eco_cohort", "eco_campaign", "gate_economics"])
def test_lines_are_dealt_by_order_once(spark, name):
    """All that adds up an order's lines reads one exchange of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum("FileScan" in x and "l_orderkey" in x for x in text.split("\n")) == 1


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with repeated lines, lines of no part or order, and orders of no lines."""
    at = str(tmp_path_factory.mktemp("odd"))
    d = duckdb.connect()
    made = {
        "lineitem": "SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE l_orderkey % 5 = 0 UNION ALL SELECT * REPLACE (-l_orderkey AS l_orderkey) FROM {0} WHERE l_orderkey % 50 = 0 UNION ALL SELECT * REPLACE (l_partkey + 1000000 AS l_partkey) FROM {0} WHERE l_orderkey % 40 = 0",
        "orders": "SELECT * FROM {0} UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM {0} WHERE o_orderkey % 20 = 0",
        "part": "SELECT * FROM {0} WHERE p_partkey % 9 <> 4",
    }
    for t in ("customer", "nation", "supplier"):
        shutil.copy(f"{SF}/{t}.parquet", at)
    for t, sql in made.items():
        d.sql(f"COPY ({sql.format(f"'{SF}/{t}.parquet'")}) TO '{at}/{t}.parquet' (FORMAT parquet)")
    for t in ("customer", "nation", "supplier", *made):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return at, d


@pytest.mark.parametrize("name", ["eco_orders", "eco_campaign", "gate_economics", "eco_spend_allocation", "eco_remittance_allocation", "eco_cost_precedence"])
def test_economics_of_odd_lines(spark, odd, name):
    at, d = odd
    assert rows_of(catalogue.QUERIES[name](spark, at)) == rows_of_sql(d, catalogue.ORACLE[name])
