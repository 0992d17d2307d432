"""Marketplace: validation, latest snapshot, the four fact tables and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.core import clean, distinct_where, errors, money, ratio
from tradewind.operators.relational import latest
from tradewind.plans.registry import query
from tradewind.sources import commerce

TYPES = ["product_viewed", "product_added_to_cart", "checkout_started", "order_created", "payment_completed", "order_shipped", "order_delivered", "order_refunded"]
KEY = ["business_id", "source_type", "source_id", "event_id"]


def classify(raw: DataFrame) -> DataFrame:
    """Cleaned events with validation_errors: every code that holds, in order. Works on streams too."""
    x = raw.withColumns({"business_id": clean("business_id", "lower"), "customer_id": clean("customer_id"), "session_id": clean("session_id"), "country": clean("country", "upper"), "currency": clean("currency", "upper"), "event_type": clean("event_type", "lower")})
    shop = F.col("source_type") == "shopify"
    codes = errors(
        (F.col("business_id").isNull() | ~F.col("business_id").rlike("^[a-z0-9][a-z0-9_-]{2,63}$"), "invalid_business_id"),
        (F.col("event_id").isNull(), "missing_event_id"),
        (F.col("event_timestamp").isNull(), "missing_event_timestamp"),
        (~shop & F.col("customer_id").isNull(), "missing_customer_id"),
        (~shop & F.col("session_id").isNull(), "missing_session_id"),
        (F.col("event_type").isNull() | ~F.col("event_type").isin(TYPES), "invalid_event_type"),
        (F.col("country").isNull() | ~F.col("country").rlike("^[A-Z]{2}$"), "invalid_country"),
        (F.col("currency").isNull() | ~F.col("currency").rlike("^[A-Z]{3}$"), "invalid_currency"),
        (F.col("quantity") <= 0, "non_positive_quantity"),
        (F.col("unit_price") < 0, "negative_unit_price"),
    )
    return x.withColumn("validation_errors", codes).withColumn("event_date", F.to_date("event_timestamp"))


CLASSIFIED_SQL = f"""{commerce.EVENTS_SQL},
cleaned AS (SELECT * REPLACE (lower(nullif(trim(business_id), '')) AS business_id, nullif(trim(customer_id), '') AS customer_id, nullif(trim(session_id), '') AS session_id,
    upper(nullif(trim(country), '')) AS country, upper(nullif(trim(currency), '')) AS currency), CAST(event_timestamp AS DATE) AS event_date FROM events_in),
coded AS (SELECT *, list_filter([
    CASE WHEN business_id IS NULL OR NOT regexp_full_match(business_id, '[a-z0-9][a-z0-9_-]{{2,63}}') THEN 'invalid_business_id' END,
    CASE WHEN event_id IS NULL THEN 'missing_event_id' END, CASE WHEN event_timestamp IS NULL THEN 'missing_event_timestamp' END,
    CASE WHEN source_type <> 'shopify' AND customer_id IS NULL THEN 'missing_customer_id' END,
    CASE WHEN source_type <> 'shopify' AND session_id IS NULL THEN 'missing_session_id' END,
    CASE WHEN event_type NOT IN ({', '.join(f"'{t}'" for t in TYPES)}) THEN 'invalid_event_type' END,
    CASE WHEN country IS NULL OR NOT regexp_full_match(country, '[A-Z]{{2}}') THEN 'invalid_country' END,
    CASE WHEN currency IS NULL OR NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'invalid_currency' END,
    CASE WHEN quantity <= 0 THEN 'non_positive_quantity' END, CASE WHEN unit_price < 0 THEN 'negative_unit_price' END], lambda x: x IS NOT NULL) AS validation_errors FROM cleaned),
silver AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id, source_type, source_id, event_id ORDER BY extracted_at DESC NULLS LAST, kafka_offset DESC NULLS LAST) AS n FROM coded WHERE len(validation_errors) = 0) WHERE n = 1),
paid AS (SELECT *, CASE WHEN event_type = 'payment_completed' THEN quantity ELSE 0 END AS units,
    CASE WHEN event_type = 'payment_completed' THEN coalesce(event_amount, coalesce(quantity, 0) * coalesce(unit_price, 0)) ELSE 0 END AS revenue FROM silver)"""


def silver(spark, sf_dir) -> DataFrame:
    """Valid events, the latest revision of each."""
    good = classify(commerce.events(spark, sf_dir)).filter(F.size("validation_errors") == 0)
    return latest(good, KEY, [F.desc_nulls_last("extracted_at"), F.desc_nulls_last("kafka_offset")])


def paid(events: DataFrame) -> DataFrame:
    pay = F.col("event_type") == "payment_completed"
    return events.withColumn("units", F.when(pay, F.col("quantity")).otherwise(0)).withColumn("revenue", F.when(pay, F.coalesce("event_amount", F.coalesce("quantity", F.lit(0)) * F.coalesce("unit_price", F.lit(0)))).otherwise(0))


def daily_sales(events: DataFrame) -> DataFrame:
    out = paid(events).filter("event_type = 'payment_completed'").groupBy("business_id", "event_date", "country", "currency").agg(F.count_distinct("order_id").alias("orders"), F.sum("units").cast("long").alias("units"), money("revenue").alias("revenue"))
    return out.withColumn("average_order_value", ratio("revenue", "orders"))


DAILY_SQL = "daily AS (SELECT business_id, event_date, country, currency, count(DISTINCT order_id) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM paid WHERE event_type = 'payment_completed' GROUP BY ALL)"


@query(f"WITH {CLASSIFIED_SQL} SELECT code, count(*) AS events, count(DISTINCT event_id) AS event_ids FROM (SELECT event_id, unnest(validation_errors) AS code FROM coded) GROUP BY code")
def mk_bronze_errors(spark, sf_dir):
    bad = classify(commerce.events(spark, sf_dir)).filter(F.size("validation_errors") > 0)
    return bad.select("event_id", F.explode("validation_errors").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("event_ids"))


@query(f"WITH {CLASSIFIED_SQL} SELECT event_id, kafka_offset, array_to_string(validation_errors, '|') AS codes FROM coded WHERE len(validation_errors) > 0")
def mk_silver_rejects(spark, sf_dir):
    return classify(commerce.events(spark, sf_dir)).filter(F.size("validation_errors") > 0).select("event_id", "kafka_offset", F.array_join("validation_errors", "|").alias("codes"))


@query(f"WITH {CLASSIFIED_SQL} SELECT business_id, source_type, source_id, event_id, event_type, kafka_offset, event_amount FROM silver")
def mk_snapshot_dedup(spark, sf_dir):
    return silver(spark, sf_dir).select(*KEY, "event_type", "kafka_offset", "event_amount")


@query(f"WITH {CLASSIFIED_SQL}, {DAILY_SQL} SELECT *, revenue / nullif(orders, 0) AS average_order_value FROM daily")
def mk_daily_sales(spark, sf_dir):
    return daily_sales(silver(spark, sf_dir))


_STEPS = {"views": "product_viewed", "carts": "product_added_to_cart", "checkouts": "checkout_started", "created": "order_created", "payments": "payment_completed", "shipped": "order_shipped", "delivered": "order_delivered", "refunds": "order_refunded"}


def _steps(names) -> list:
    return [F.count_if(F.col("event_type") == _STEPS[n]).alias(n) for n in names]


def _steps_sql(names) -> str:
    return ", ".join(f"count(*) FILTER (WHERE event_type = '{_STEPS[n]}') AS {n}" for n in names)


_CUSTOMER = ["views", "carts", "checkouts", "created", "payments", "delivered", "refunds"]


def customer_metrics(events: DataFrame) -> DataFrame:
    return paid(events).filter("customer_id is not null").groupBy("business_id", "customer_id", "currency").agg(
        F.min("event_timestamp").alias("first_seen"), F.max("event_timestamp").alias("last_seen"), *_steps(_CUSTOMER), F.sum("units").cast("long").alias("units"), money("revenue").alias("revenue"),
        distinct_where(F.col("event_type") == "payment_completed", "order_id").alias("orders"))


CUSTOMER_SQL = f"customers AS (SELECT business_id, customer_id, currency, min(event_timestamp) AS first_seen, max(event_timestamp) AS last_seen, {_steps_sql(_CUSTOMER)}, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(DISTINCT order_id) FILTER (WHERE event_type = 'payment_completed') AS orders FROM paid WHERE customer_id IS NOT NULL GROUP BY business_id, customer_id, currency)"


@query(f"WITH {CLASSIFIED_SQL}, {CUSTOMER_SQL} SELECT * FROM customers")
def mk_customer_metrics(spark, sf_dir):
    return customer_metrics(silver(spark, sf_dir))


_PRODUCT = ["views", "carts", "payments", "refunds"]


def product_metrics(events: DataFrame) -> DataFrame:
    """The seller is told only where all of a product's events name the same; min and max decide, no set is gathered."""
    one = F.when((F.min("seller_id") == F.max("seller_id")) & (F.count("seller_id") > 0), F.min("seller_id"))
    return paid(events).groupBy("business_id", "product_id", "currency").agg(one.alias("seller_id"), *_steps(_PRODUCT), F.count_distinct("customer_id").alias("customers"), F.sum("units").cast("long").alias("units"), money("revenue").alias("revenue"))


PRODUCT_SQL = f"products AS (SELECT business_id, product_id, currency, CASE WHEN count(DISTINCT seller_id) = 1 THEN min(seller_id) END AS seller_id, {_steps_sql(_PRODUCT)}, count(DISTINCT customer_id) AS customers, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM paid GROUP BY business_id, product_id, currency)"


@query(f"WITH {CLASSIFIED_SQL}, {PRODUCT_SQL} SELECT * FROM products")
def mk_product_metrics(spark, sf_dir):
    return product_metrics(silver(spark, sf_dir))


_FUNNEL = ["views", "carts", "checkouts", "created", "payments", "shipped", "delivered"]


@query(f"""WITH {CLASSIFIED_SQL}, f AS (SELECT business_id, event_date, country, {_steps_sql(_FUNNEL)} FROM silver WHERE source_type <> 'shopify' GROUP BY ALL)
SELECT *, carts / nullif(views, 0) AS view_to_cart, checkouts / nullif(carts, 0) AS cart_to_checkout, payments / nullif(checkouts, 0) AS checkout_to_payment, delivered / nullif(shipped, 0) AS shipped_to_delivered FROM f""")
def mk_funnel(spark, sf_dir):
    f = silver(spark, sf_dir).filter("source_type <> 'shopify'").groupBy("business_id", "event_date", "country").agg(*_steps(_FUNNEL))
    return f.withColumns({"view_to_cart": ratio("carts", "views"), "cart_to_checkout": ratio("checkouts", "carts"), "checkout_to_payment": ratio("payments", "checkouts"), "shipped_to_delivered": ratio("delivered", "shipped")})


def revenue_by_day(sales: DataFrame) -> DataFrame:
    out = sales.groupBy("business_id", "event_date", "currency").agg(F.sum("orders").cast("long").alias("orders"), F.sum("units").cast("long").alias("units"), money("revenue").alias("revenue"))
    return out.withColumn("average_order_value", ratio("revenue", "orders"))


BY_DAY_SQL = "by_day AS (SELECT business_id, event_date, currency, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM daily GROUP BY ALL)"


@query(f"WITH {CLASSIFIED_SQL}, {DAILY_SQL}, {BY_DAY_SQL} SELECT *, revenue / nullif(orders, 0) AS average_order_value FROM by_day")
def mk_revenue_by_day(spark, sf_dir):
    return revenue_by_day(daily_sales(silver(spark, sf_dir)))


@query(f"WITH {CLASSIFIED_SQL}, {DAILY_SQL}, {BY_DAY_SQL} SELECT currency, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / nullif(sum(orders), 0) AS average_order_value FROM by_day GROUP BY currency")
def revenue_overview(spark, sf_dir):
    o = revenue_by_day(daily_sales(silver(spark, sf_dir))).groupBy("currency").agg(F.sum("orders").cast("long").alias("orders"), F.sum("units").cast("long").alias("units"), money("revenue").alias("revenue"))
    return o.withColumn("average_order_value", ratio("revenue", "orders"))


@query(f"WITH {CLASSIFIED_SQL}, {CUSTOMER_SQL} SELECT business_id, customer_id, currency, revenue, orders, revenue_rank FROM (SELECT *, rank() OVER (PARTITION BY business_id, currency ORDER BY revenue DESC) AS revenue_rank FROM customers) WHERE revenue_rank <= 15")
def mk_top_customers(spark, sf_dir):
    w = Window.partitionBy("business_id", "currency").orderBy(F.desc("revenue"))
    return customer_metrics(silver(spark, sf_dir)).withColumn("revenue_rank", F.rank().over(w)).filter("revenue_rank <= 15").select("business_id", "customer_id", "currency", "revenue", "orders", "revenue_rank")


@query(f"WITH {CLASSIFIED_SQL}, {PRODUCT_SQL} SELECT business_id, product_id, currency, units, revenue, dense_rank() OVER (PARTITION BY business_id ORDER BY units DESC) AS units_rank FROM products ORDER BY revenue DESC, business_id, product_id, currency LIMIT 20")
def mk_top_products(spark, sf_dir):
    """The rank of a few rows is the number of distinct values above them: no window over all products of a business."""
    columns = ["business_id", "product_id", "currency", "units", "revenue"]
    products = product_metrics(silver(spark, sf_dir)).select(*columns)
    top = products.orderBy(F.desc("revenue"), "business_id", "product_id", "currency").limit(20)
    values = products.select(F.col("business_id").alias("b"), F.col("units").alias("above")).distinct()
    met = top.join(values, F.col("business_id").eqNullSafe(F.col("b")) & (F.col("above") > F.col("units")), "left")
    return met.groupBy(*columns).agg((F.count("above") + 1).cast("int").alias("units_rank"))


@query(f"WITH {CLASSIFIED_SQL}, {DAILY_SQL} SELECT country, currency, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / nullif(sum(orders), 0) AS average_order_value FROM daily GROUP BY country, currency")
def mk_geography(spark, sf_dir):
    g = daily_sales(silver(spark, sf_dir)).groupBy("country", "currency").agg(F.sum("orders").cast("long").alias("orders"), money("revenue").alias("revenue"))
    return g.withColumn("average_order_value", ratio("revenue", "orders"))
