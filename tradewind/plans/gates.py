"""Gates between layers: existence, grain and sanity, eligible input against output, policies made from schemas, economics checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import quality as Q
from tradewind.plans import economics as eco
from tradewind.plans import marketplace as mk
from tradewind.plans.checks import _row
from tradewind.plans.registry import query
from tradewind.sources import commerce


def exists(df: DataFrame) -> DataFrame:
    """One row (passed): whether df has a row; stops at the first."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("passed"))


def none(df: DataFrame) -> DataFrame:
    """One row (passed): whether df has no row; stops at the first."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("passed"))


def repeated(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, null keys included."""
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _named(df: DataFrame, layer: str, check: str) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), F.lit(check).alias("check"), "passed")


@query(f"""WITH {mk.CLASSIFIED_SQL}, {mk.DAILY_SQL}, {mk.CUSTOMER_SQL}
SELECT 'bronze' AS layer, 'non_empty' AS "check", count(*) > 0 AS passed FROM coded
UNION ALL SELECT 'silver', 'non_empty', count(*) > 0 FROM silver
UNION ALL SELECT 'silver', 'unique_grain', NOT EXISTS (SELECT 1 FROM silver GROUP BY business_id, source_type, source_id, event_id HAVING count(*) > 1)
UNION ALL SELECT 'silver', 'unique_session', NOT EXISTS (SELECT 1 FROM silver GROUP BY session_id HAVING count(*) > 1)
UNION ALL SELECT 'gold', 'sales_non_empty', count(*) > 0 FROM daily
UNION ALL SELECT 'gold', 'sales_not_negative', count(*) = 0 FROM daily WHERE revenue < 0 OR units < 0 OR orders < 0
UNION ALL SELECT 'gold', 'customers_bought', count(*) = 0 FROM customers WHERE units = 0""")
def gate_layers(spark, sf_dir):
    raw, good = mk.classify(commerce.events(spark, sf_dir)), mk.silver(spark, sf_dir)
    sales, customers = mk.daily_sales(good), mk.customer_metrics(good)
    parts = [
        _named(exists(raw), "bronze", "non_empty"),
        _named(exists(good), "silver", "non_empty"),
        _named(none(repeated(good, mk.KEY)), "silver", "unique_grain"),
        _named(none(repeated(good, ["session_id"])), "silver", "unique_session"),
        _named(exists(sales), "gold", "sales_non_empty"),
        _named(none(sales.filter("revenue < 0 or units < 0 or orders < 0")), "gold", "sales_not_negative"),
        _named(none(customers.filter("units = 0")), "gold", "customers_bought"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {mk.CLASSIFIED_SQL}, {mk.DAILY_SQL}, {mk.CUSTOMER_SQL}, {mk.PRODUCT_SQL},
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'payment_completed') AS payments, count(product_id) AS products, count(customer_id) AS buyers FROM silver),
o AS (SELECT 'daily_sales' AS name, payments AS eligible, (SELECT count(*) FROM daily) AS output FROM n UNION ALL SELECT 'customer_metrics', buyers, (SELECT count(*) FROM customers) FROM n UNION ALL SELECT 'product_metrics', products, (SELECT count(*) FROM products) FROM n)
SELECT name, eligible, output, output >= CASE WHEN eligible > 0 THEN 1 ELSE 0 END AS passed FROM o""")
def gate_silver_gold(spark, sf_dir):
    """A Gold table may be empty only where Silver has nothing for it."""
    good = mk.silver(spark, sf_dir)
    n = good.agg(F.count_if(F.col("event_type") == "payment_completed").alias("daily_sales"), F.count("customer_id").alias("customer_metrics"), F.count("product_id").alias("product_metrics"))
    eligible = n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("eligible")) for c in n.columns])))
    tables = {"daily_sales": mk.daily_sales(good), "customer_metrics": mk.customer_metrics(good), "product_metrics": mk.product_metrics(good)}
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("output")).select(F.lit(name).alias("name"), "output")
        rows = part if rows is None else rows.unionByName(part)
    return eligible.join(rows, "name").withColumn("passed", F.col("output") >= (F.col("eligible") > 0).cast("int"))


def policy(df: DataFrame, grain: Sequence[str]) -> list:
    """Rules from a table's schema: rows at all, the grain whole and unique, no number outside the grain below nought."""
    numbers = [f.name for f in df.schema.fields if f.name not in grain and f.dataType.typeName() in ("long", "integer", "double", "decimal")]
    return [Q.row_count(1), *[Q.not_null(c) for c in grain], Q.unique(*grain), *[Q.bounds(c, 0, None, null_ok=True) for c in numbers]]


_GRAIN = ["business_id", "event_date", "country", "currency"]
_BAD = "(SELECT count(*) FROM daily WHERE {})"


@query(f"WITH {mk.CLASSIFIED_SQL}, {mk.DAILY_SQL} " + " UNION ALL ".join([
    "SELECT 'row_count' AS rule, 'CRITICAL' AS severity, (SELECT count(*) FROM daily)::DOUBLE AS observed, 1::DOUBLE AS threshold, CASE WHEN (SELECT count(*) FROM daily) >= 1 THEN 'PASS' ELSE 'FAIL' END AS status",
    *[_row(f"not_null:{c}", "CRITICAL", _BAD.format(f"{c} IS NULL"), "daily") for c in _GRAIN],
    _row(f"unique:{','.join(_GRAIN)}", "CRITICAL", f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM daily GROUP BY {', '.join(_GRAIN)}))", "daily"),
    *[_row(f"bounds:{c}", "CRITICAL", _BAD.format(f"{c} < 0"), "daily") for c in ("orders", "units", "revenue")],
]))
def gate_policies(spark, sf_dir):
    daily = mk.daily_sales(mk.silver(spark, sf_dir)).drop("average_order_value")
    return Q.run(daily, policy(daily, _GRAIN))


@query(f"""WITH {eco._ORDERS_SQL},
s AS (SELECT campaign, month, max(spend) AS spend, sum(CAST(round(order_spend, 8) AS DECIMAL(28,8))) AS allotted FROM shared GROUP BY 1, 2),
r AS (SELECT remittance_id, max(net) AS net, sum(CAST(round(order_net, 3) AS DECIMAL(18,3))) AS allotted, count(*) AS n FROM allotted GROUP BY 1)
SELECT 'contribution_mismatch' AS code, count(*) AS violations FROM eco WHERE abs(contribution - (recognised_value - cogs - other_costs)) > 0.001
UNION ALL SELECT 'duplicate_order', count(*) FROM (SELECT order_id FROM eco GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'negative_cost', count(*) FROM eco WHERE cogs < 0 OR other_costs < 0 OR marketing_spend < 0
UNION ALL SELECT 'complete_without_costs', count(*) FROM eco WHERE economic_status = 'COMPLETE' AND NOT cogs_complete
UNION ALL SELECT 'spend_unreconciled', count(*) FROM s WHERE abs(spend - allotted) > 0.01
UNION ALL SELECT 'remittance_unreconciled', count(*) FROM r WHERE abs(net - allotted) > 0.01 * n""")
def gate_economics(spark, sf_dir):
    slim = eco.slim_lines(spark, sf_dir)
    links = eco.spend_links(spark, sf_dir, eco.sold_lines(spark, sf_dir, slim))
    facts = eco.orders(spark, sf_dir, slim, links)
    count = lambda code, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(code).alias("code"), "violations")
    # all checks of a row in one pass
    row_checks = {
        "contribution_mismatch": "abs(contribution - (recognised_value - cogs - other_costs)) > 0.001",
        "negative_cost": "cogs < 0 or other_costs < 0 or marketing_spend < 0",
        "complete_without_costs": "economic_status = 'COMPLETE' and not cogs_complete",
    }
    once = facts.agg(*[F.count_if(F.expr(e)).alias(c) for c, e in row_checks.items()])
    out = once.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in row_checks])))
    out = out.unionByName(count("duplicate_order", repeated(facts.select("order_id"), ["order_id"])))
    spent = links.groupBy("campaign", "month").agg(F.max("spend").alias("spend"), F.sum(F.round("order_spend", 8).cast("decimal(28,8)")).cast("double").alias("allotted"))
    out = out.unionByName(count("spend_unreconciled", spent.filter("abs(spend - allotted) > 0.01")))
    paid = eco.remittance_links(spark, sf_dir, slim).groupBy("remittance_id").agg(F.max("net").alias("net"), F.sum(F.round("order_net", 3).cast("decimal(18,3)")).cast("double").alias("allotted"), F.count(F.lit(1)).alias("n"))
    return out.unionByName(count("remittance_unreconciled", paid.filter("abs(net - allotted) > 0.01 * n")))
