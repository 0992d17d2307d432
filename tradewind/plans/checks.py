"""Quality rules over the canonical tables, and reconciliations between layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import quality as Q
from tradewind.operators.relational import duplicate_excess
from tradewind.plans import marketplace as mk
from tradewind.plans import operations as ops
from tradewind.plans.registry import query, table
from tradewind.sources import commerce

_N = "(SELECT count(*) FROM {t})"


def _row(rule: str, severity: str, bad: str, t: str, most: float = 0.0) -> str:
    word = "FAIL" if severity == "CRITICAL" else "WARN"
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, ({bad}) / {_N.format(t=t)}::DOUBLE AS observed, {most}::DOUBLE AS threshold, CASE WHEN {_N.format(t=t)} = 0 THEN 'WARN' WHEN ({bad}) / {_N.format(t=t)}::DOUBLE <= {most} THEN 'PASS' ELSE '{word}' END AS status"


_LI = "(SELECT count(*) FROM lineitem WHERE {})"
_DQ = " UNION ALL ".join(
    [
        "SELECT 'row_count' AS rule, 'CRITICAL' AS severity, (SELECT count(*) FROM lineitem)::DOUBLE AS observed, 1::DOUBLE AS threshold, CASE WHEN (SELECT count(*) FROM lineitem) >= 1 THEN 'PASS' ELSE 'FAIL' END AS status",
        _row("not_null:l_orderkey", "CRITICAL", _LI.format("l_orderkey IS NULL"), "lineitem"),
        _row("allowed:l_returnflag", "CRITICAL", _LI.format("l_returnflag NOT IN ('A', 'N')"), "lineitem"),
        _row("bounds:l_discount", "CRITICAL", _LI.format("l_discount < 0 OR l_discount > 0.05"), "lineitem"),
        _row("bounds:l_quantity", "WARNING", _LI.format("l_quantity <= 1"), "lineitem"),
        _row("pattern:l_linestatus", "CRITICAL", _LI.format("NOT regexp_matches(l_linestatus, '^[FO]$')"), "lineitem"),
        _row("unique:l_orderkey,l_linenumber", "CRITICAL", "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))", "lineitem", 0.5),
        "SELECT 'not_null:l_missing', 'CRITICAL', NULL::DOUBLE, NULL::DOUBLE, 'FAIL'",
    ]
)


def _rules():
    return [
        Q.row_count(1), Q.not_null("l_orderkey"), Q.allowed("l_returnflag", ["A", "N"]), Q.bounds("l_discount", 0, 0.05), Q.bounds("l_quantity", 1, None, strict=True, severity="WARNING"),
        Q.pattern("l_linestatus", "^[FO]$"), Q.unique("l_orderkey", "l_linenumber", most=0.5), Q.not_null("l_missing"),
    ]


@query(_DQ)
def dq_rules(spark, sf_dir):
    return Q.run(table(spark, sf_dir, "lineitem"), _rules())


@query(f"""SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status, bool_or(status = 'FAIL' AND severity = 'CRITICAL') AS blocking, count(*) AS rules FROM ({_DQ})""")
def dq_summary(spark, sf_dir):
    return Q.summary(Q.run(table(spark, sf_dir, "lineitem"), _rules()))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type, CAST(ts AS DATE))")
def dq_uniqueness(spark, sf_dir):
    return duplicate_excess(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"])


@query(f"""WITH {mk.CLASSIFIED_SQL} SELECT (SELECT count(*) FROM coded) AS bronze_rows, (SELECT count(*) FROM coded WHERE len(validation_errors) = 0) AS valid_rows, (SELECT count(*) FROM silver) AS silver_rows,
 (SELECT count(*) FROM (SELECT DISTINCT business_id, source_type, source_id, event_id FROM coded WHERE len(validation_errors) = 0)) AS expected_rows""")
def dq_reconcile(spark, sf_dir):
    """Bronze against Silver: the classifier runs again and counts whole keys; three one-row tables side by side."""
    c = mk.classify(commerce.events(spark, sf_dir))
    good = c.filter(F.size("validation_errors") == 0)
    counts = c.agg(F.count(F.lit(1)).alias("bronze_rows"), F.count_if(F.size("validation_errors") == 0).alias("valid_rows"))
    return counts.crossJoin(mk.silver(spark, sf_dir).agg(F.count(F.lit(1)).alias("silver_rows"))).crossJoin(good.select(*mk.KEY).distinct().agg(F.count(F.lit(1)).alias("expected_rows")))


@query(f"""WITH {ops.EVENTS_SQL}, {ops.CASH_SQL}, d AS (SELECT DISTINCT order_id FROM op_events WHERE status = 'DELIVERED'), c AS (SELECT DISTINCT order_id FROM op_events WHERE status = 'CONFIRMED'), s AS (SELECT DISTINCT order_id FROM op_events WHERE status = 'SHIPPED')
SELECT 'cash_without_delivery' AS code, count(*) AS orders FROM cash WHERE order_id NOT IN (SELECT order_id FROM d)
UNION ALL SELECT 'shipped_without_confirmation', count(*) FROM s WHERE order_id NOT IN (SELECT order_id FROM c)
UNION ALL SELECT 'delivered_before_created', count(DISTINCT e.order_id) FROM op_events e JOIN orders_in o ON e.order_id = o.order_id WHERE e.status = 'DELIVERED' AND e.event_at < o.created_at
UNION ALL SELECT 'order_without_line', count(*) FROM orders_in WHERE order_id NOT IN (SELECT order_id FROM lines_in)""")
def dq_operations(spark, sf_dir):
    e = ops.events(spark, sf_dir)
    having = lambda s: e.filter(F.col("status") == s).select("order_id").distinct()
    o = commerce.orders(spark, sf_dir)
    count = lambda code, df: df.agg(F.count_distinct("order_id").alias("orders")).select(F.lit(code).alias("code"), "orders")
    early = e.filter("status = 'DELIVERED'").join(o.select("order_id", "created_at"), "order_id").filter("event_at < created_at")
    parts = [count("cash_without_delivery", ops.cash(spark, sf_dir).join(having("DELIVERED"), "order_id", "left_anti")), count("shipped_without_confirmation", having("SHIPPED").join(having("CONFIRMED"), "order_id", "left_anti")), count("delivered_before_created", early), count("order_without_line", o.join(commerce.lines(spark, sf_dir), "order_id", "left_anti"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
