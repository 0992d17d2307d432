"""Plans that must hold at any size: no key is one task, nested layers plan fast."""

import io
import time
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tradewind.operators import relational
from tradewind.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_totals_are_joined_over_exchanges_on_both_sides(spark):
    """Adaptive execution splits a hot key only where both sides were dealt for the join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_tax")
        text = plan(relational.with_totals(df, ["l_partkey", "l_suppkey"], {"t": F.sum("l_tax")}))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join, sides = text.split("SortMergeJoin")[1].split("\n", 1)
    assert sides.count("Exchange hashpartitioning(coalesce(") == 2 and sides.count("Exchange") == 3


def test_signals_are_numbered_without_one_task(spark):
    text = plan(catalogue.QUERIES["dx_signals"](spark, SF))
    assert "Exchange SinglePartition" not in text.split("Window")[0]


def test_layers_plan_fast(spark):
    for name in ("slv_active_daily", "slv_valid", "slv_rejected", "brz_codes"):
        df = catalogue.QUERIES[name](spark, SF)
        began = time.time()
        df._jdf.queryExecution().executedPlan()
        assert time.time() - began < 10, name
