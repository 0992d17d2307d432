"""The driver's tables as the platform's canonical inputs.

Each input is a list of plain expressions, good in Spark and in DuckDB alike, so that the
queries' SQL starts from the same rows: frame() selects them in Spark, cte() writes them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: events: the marketplace stream as it arrives, with planted faults by number.
EVENTS = {
    "business_id": "case when event_id % 211 = 0 then 'B!' else concat('biz_', user_id % 3) end",
    "source_type": "case when user_id % 5 = 0 then 'shopify' else 'marketplace' end",
    "source_id": "concat('src_', user_id % 2)",
    "schema_version": "'1'",
    "event_id": "concat('evt_', event_id)",
    "event_type": "case when event_id % 97 = 0 then 'unheard_of' when event_type = 'view' then 'product_viewed' when event_type = 'click' then 'product_added_to_cart' when event_type = 'signup' then 'checkout_started' when event_type = 'purchase' then 'payment_completed' else 'order_refunded' end",
    "event_timestamp": "ts",
    "customer_id": "case when event_id % 83 = 0 then ' ' else concat('cus_', user_id) end",
    "session_id": "concat(' ses_', event_id % 89)",
    "country": "case when event_id % 71 = 0 then 'usa' when user_id % 4 = 0 then 'us' when user_id % 4 = 1 then 'DE' when user_id % 4 = 2 then 'FR' else 'MA' end",
    "product_id": "concat('prd_', event_id % 40)",
    "seller_id": "concat('sel_', event_id % 80 % 7)",
    "order_id": "concat('ord_', cast(floor(event_id / 2) as bigint))",
    "currency": "case when user_id % 2 = 0 then 'usd' else 'EUR' end",
    "quantity": "case when event_id % 67 = 0 then 0 else 1 + event_id % 3 end",
    "unit_price": "value",
    "event_amount": "case when event_id % 5 = 0 then null else value end",
    "event_number": "event_id",
}
#: A slice arrives twice, later and with another amount.
REPLAY = "event_id % 10 = 0"

REGION_CURRENCY = "case n_regionkey when 0 then 'MAD' when 1 then 'USD' when 2 then 'CNY' when 3 then 'EUR' else 'AED' end"
REGION_ZONE = "case n_regionkey when 0 then 'Africa/Casablanca' when 1 then 'America/New_York' when 2 then 'Asia/Shanghai' when 3 then 'Europe/Paris' else 'Asia/Dubai' end"
#: orders with customer and nation.
ORDERS = {
    "business_id": "concat('biz_', n_regionkey)",
    "order_id": "o_orderkey",
    "customer_id": "o_custkey",
    "country": "n_name",
    "currency": REGION_CURRENCY,
    "time_zone": REGION_ZONE,
    "payment_type": "case when substring(o_orderpriority, 1, 1) in ('1', '2') then 'PREPAID' else 'COD' end",
    "order_value": "o_totalprice",
    "created_at": "o_orderdate",
    "provider_status": "o_orderstatus",
}
ORDERS_FROM = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
#: lineitem, numbered so that lines are told apart.
LINES = {
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "supplier_id": "l_suppkey",
    "line_number": "l_linenumber",
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "returnflag": "l_returnflag",
    "linestatus": "l_linestatus",
    "shipped_at": "l_shipdate",
}
#: lineitem as ad reports: supplier is the campaign, brand group the ad group, part the ad.
ADS = {
    "business_id": "concat('biz_', l_suppkey % 3)",
    "platform": "case l_suppkey % 3 when 0 then 'meta' when 1 then 'tiktok' else 'google' end",
    "campaign_id": "concat('cmp_', l_suppkey)",
    "ad_group_id": "concat('grp_', l_suppkey, '_', l_partkey % 5)",
    "ad_id": "concat('ad_', l_suppkey, '_', l_partkey % 25)",
    "report_date": "cast(l_shipdate as date)",
    "currency": "case l_suppkey % 2 when 0 then 'USD' else 'EUR' end",
    "spend": "l_extendedprice * l_discount",
    "impressions": "cast(l_quantity * 100 as bigint)",
    "clicks": "cast(l_quantity as bigint)",
    "conversions": "cast(case when l_returnflag = 'R' then l_quantity else null end as double)",
    "conversion_value": "case when l_returnflag = 'R' then l_extendedprice else null end",
    "revision": "l_linenumber",
    "native": "l_orderkey",
}


def _select(spec: dict[str, str]) -> list[str]:
    return [f"{e} as {c}" for c, e in spec.items()]


def _sql(spec: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_select(spec))} FROM {source}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw marketplace stream, some of it twice (a later offset and extraction)."""
    raw = read(spark, sf_dir, "events").selectExpr(*_select(EVENTS), f"{REPLAY} as replayed")
    first = raw.selectExpr("* except (replayed)", "event_number as kafka_offset", "event_timestamp as extracted_at")
    again = raw.filter("replayed").selectExpr("* except (replayed, event_amount)", "event_amount + 1 as event_amount", "event_number + 100000000 as kafka_offset", "event_timestamp + interval 1 hour as extracted_at")
    return first.unionByName(again)


EVENTS_SQL = f"""raw AS ({_sql(EVENTS | {"replayed": REPLAY}, "events")}),
events_in AS (SELECT * EXCLUDE (replayed), event_number AS kafka_offset, event_timestamp AS extracted_at FROM raw
  UNION ALL BY NAME SELECT * EXCLUDE (replayed, event_amount), event_amount + 1 AS event_amount, event_number + 100000000 AS kafka_offset, event_timestamp + INTERVAL 1 HOUR AS extracted_at FROM raw WHERE replayed)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commerce orders. customer and nation grow with the data or not at all; Catalyst picks the joins by size."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).selectExpr(*_select(ORDERS))


ORDERS_SQL = f"orders_in AS ({_sql(ORDERS, ORDERS_FROM)})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_select(LINES))


LINES_SQL = f"lines_in AS ({_sql(LINES, 'lineitem')})"


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_select(ADS))


ADS_SQL = f"ads_in AS ({_sql(ADS, 'lineitem')})"
