"""Order operations: lifecycle events, current state, days, confirmation, delivery, collection, remittance, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.core import money, ratio
from tradewind.plans.registry import query, shares
from tradewind.sources import commerce

#: Stages in order; a later stage at the same instant wins.
STAGES = {"CREATED": 0, "CONFIRMED": 1, "REJECTED": 1, "SHIPPED": 2, "DELIVERY_ATTEMPTED": 3, "DELIVERED": 4, "RETURNED": 5}
#: Status that may follow a status.
ALLOWED = {
    "CREATED": ["CONFIRMED", "REJECTED"], "CONFIRMED": ["SHIPPED"], "REJECTED": [], "SHIPPED": ["SHIPPED", "DELIVERY_ATTEMPTED", "DELIVERED", "RETURNED"],
    "DELIVERY_ATTEMPTED": ["DELIVERY_ATTEMPTED", "DELIVERED", "RETURNED", "SHIPPED"], "DELIVERED": ["RETURNED", "SHIPPED", "DELIVERED"], "RETURNED": ["RETURNED", "SHIPPED", "DELIVERED"],
}
AS_OF = "1998-01-01"
#: (status, hours after, condition) from an order, and (status, days after shipping, condition) from a line.
_FROM_ORDERS = [("CREATED", "0", "true"), ("CONFIRMED", "2", "provider_status in ('F', 'O')"), ("REJECTED", "3", "provider_status = 'P'")]
_FROM_LINES = [("SHIPPED", "0", "true"), ("DELIVERY_ATTEMPTED", "1", "linestatus = 'F' and line_number > 1"), ("DELIVERED", "2", "linestatus = 'F'"), ("RETURNED", "9", "returnflag = 'R' and linestatus = 'F'")]


def _stage(status: str) -> list[str]:
    return [f"'{status}' as status", f"{STAGES[status]} as stage"]


def _courier(prefix: str = "") -> str:
    return f"concat('courier_', {prefix}supplier_id % 5) as courier"


def _inline(parts: list[tuple[str, str, str]], start: str, unit: str, courier: str, shipment: str) -> str:
    """All events of one row at once, so that a source is read and joined once and not once a status."""
    each = [f"case when {cond} then struct({', '.join(_stage(status))}, {start} + interval {n} {unit} as event_at, {courier} as courier, {shipment} as shipment_id) end" for status, n, cond in parts]
    return f"inline(filter(array({', '.join(each)}), x -> x is not null))"


def events(spark, sf_dir) -> DataFrame:
    """(business, order, status, stage, event_at, courier, shipment) from orders and their lines."""
    o = commerce.orders(spark, sf_dir)
    cols = ["business_id", "order_id", "time_zone"]
    own = o.selectExpr(*cols, _inline(_FROM_ORDERS, "created_at", "hour", "cast(null as string)", "cast(null as string)"))
    lines = commerce.lines(spark, sf_dir).repartition(shares(spark, sf_dir, "lineitem"), "order_id").join(o.select(*cols), "order_id")
    return own.unionByName(lines.selectExpr(*cols, _inline(_FROM_LINES, "shipped_at", "day", "concat('courier_', supplier_id % 5)", "concat(order_id, '-', supplier_id)")))


def _union_sql() -> str:
    parts = [f"SELECT business_id, order_id, time_zone, {', '.join(_stage(s))}, created_at + INTERVAL {h} HOUR AS event_at, NULL AS courier, NULL AS shipment_id FROM orders_in WHERE {c}" for s, h, c in _FROM_ORDERS]
    parts += [f"SELECT o.business_id, o.order_id, o.time_zone, {', '.join(_stage(s))}, shipped_at + INTERVAL {d} DAY AS event_at, {_courier()}, concat(l.order_id, '-', supplier_id) AS shipment_id FROM lines_in l JOIN orders_in o ON l.order_id = o.order_id WHERE {c}" for s, d, c in _FROM_LINES]
    return " UNION ALL ".join(parts)


EVENTS_SQL = f"{commerce.ORDERS_SQL}, {commerce.LINES_SQL}, op_events AS ({_union_sql()})"
_DAY_SQL = "CAST(timezone(time_zone, timezone('UTC', {0})) AS DATE)"


def zone_day(c: str):
    return F.to_date(F.from_utc_timestamp(F.col(c).cast("timestamp"), F.col("time_zone")))


def cash(spark, sf_dir) -> DataFrame:
    """(order, cash): what delivered lines of orders on delivery brought; the return of a line takes its cash back."""
    o = commerce.orders(spark, sf_dir).filter("payment_type = 'COD'")
    paid = commerce.lines(spark, sf_dir).filter("linestatus = 'F' and returnflag <> 'R'").join(o.select("order_id"), "order_id")
    return paid.groupBy("order_id").agg(money("price").alias("cash_collected"))


CASH_SQL = "cash AS (SELECT l.order_id, CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) AS cash_collected FROM lines_in l JOIN orders_in o ON l.order_id = o.order_id WHERE payment_type = 'COD' AND linestatus = 'F' AND returnflag <> 'R' GROUP BY 1)"


def _times(parts: list[tuple[str, str, str]], start: str, unit: str) -> list[Column]:
    """Aggregates first_, last_ and has_ of each status."""
    at = [(status.lower(), F.expr(cond), F.expr(f"case when {cond} then {start} + interval {n} {unit} end")) for status, n, cond in parts]
    return [c for s, cond, x in at for c in (F.min(x).alias(f"first_{s}"), F.max(x).alias(f"last_{s}"), F.bool_or(cond).alias(f"has_{s}"))]


def current(spark, sf_dir) -> DataFrame:
    """One row an order: its last status by occurrence, first times, attempts, shipments, cash."""
    own = commerce.orders(spark, sf_dir).groupBy("business_id", "order_id").agg(F.count(F.lit(1)).alias("copies"), *_times(_FROM_ORDERS, "created_at", "hour"))
    # lines are added up before they meet their order: no row for each event, and only fixed-width values
    lines = commerce.lines(spark, sf_dir).repartition(shares(spark, sf_dir, "lineitem"), "order_id").groupBy("order_id").agg(*_times(_FROM_LINES, "shipped_at", "day"), F.count_if(F.expr(_FROM_LINES[1][2])).alias("line_attempts"), F.count_distinct("supplier_id").alias("line_shipments"))
    last = F.greatest(*[F.when(F.col(f"has_{s.lower()}"), F.struct(F.col(f"last_{s.lower()}").alias("event_at"), F.lit(k).alias("stage"), F.lit(s).alias("status"))) for s, k in STAGES.items()])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    facts = own.join(lines, "order_id", "left").select(
        "business_id", "order_id", last.alias("last"), *[F.col(f"first_{s.lower()}").alias(f"{s.lower()}_at") for s in ("CONFIRMED", "SHIPPED", "DELIVERED")],
        (zero("line_attempts") * F.col("copies")).alias("attempts"), zero("line_shipments").alias("shipments"))
    out = facts.join(cash(spark, sf_dir), "order_id", "left")
    return out.select("business_id", "order_id", F.col("last.status").alias("status"), F.col("last.event_at").alias("status_at"), "confirmed_at", "shipped_at", "delivered_at", "attempts", "shipments", F.coalesce("cash_collected", F.lit(0.0)).alias("cash_collected"))


CURRENT_SQL = f"""{EVENTS_SQL}, {CASH_SQL}, facts AS (SELECT business_id, order_id, max({{'event_at': event_at, 'stage': stage, 'status': status}}) AS last,
  min(event_at) FILTER (WHERE status = 'CONFIRMED') AS confirmed_at, min(event_at) FILTER (WHERE status = 'SHIPPED') AS shipped_at, min(event_at) FILTER (WHERE status = 'DELIVERED') AS delivered_at,
  count(*) FILTER (WHERE status = 'DELIVERY_ATTEMPTED') AS attempts, count(DISTINCT shipment_id) AS shipments FROM op_events GROUP BY 1, 2),
current AS (SELECT business_id, f.order_id, last.status AS status, last.event_at AS status_at, confirmed_at, shipped_at, delivered_at, attempts, shipments, coalesce(cash_collected, 0) AS cash_collected FROM facts f LEFT JOIN cash USING (order_id))"""


@query(f"WITH {CURRENT_SQL} SELECT * FROM current")
def ops_current(spark, sf_dir):
    return current(spark, sf_dir)


@query(f"""WITH {EVENTS_SQL} SELECT business_id, {_DAY_SQL.format('event_at')} AS day, {', '.join(f"count(DISTINCT order_id) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in STAGES)}, count(DISTINCT order_id) AS orders FROM op_events GROUP BY 1, 2""")
def ops_daily(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", zone_day("event_at"))
    # a row for each (day, order) first, its statuses as bits: one plain aggregate instead of an expansion for each distinct count
    bit = F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, 1 << k)])[F.col("status")]
    seen = e.repartition(shares(spark, sf_dir, "lineitem"), "order_id").groupBy("business_id", "day", "order_id").agg(F.bit_or(bit).alias("seen"))
    return seen.groupBy("business_id", "day").agg(*[F.count(F.when(F.col("seen").bitwiseAND(F.lit(1 << k)) > 0, F.col("order_id"))).alias(s.lower()) for k, s in enumerate(STAGES)], F.count("order_id").alias("orders"))


_FLAGS_SQL = ", ".join(f"bool_or(status = '{s}') AS is_{s.lower()}" for s in STAGES)


def flags(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("business_id", "order_id").agg(*[F.bool_or(F.col("status") == s).alias(f"is_{s.lower()}") for s in STAGES], F.min(F.when(F.col("status") == "CONFIRMED", F.col("event_at"))).alias("confirmed_at"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT order_id, {_FLAGS_SQL}, min(event_at) FILTER (WHERE status = 'CONFIRMED') AS confirmed_at FROM op_events GROUP BY 1),
c AS (SELECT business_id, {_DAY_SQL.format('created_at')} AS cohort, count(*) AS eligible, count(*) FILTER (WHERE is_confirmed) AS confirmed, count(*) FILTER (WHERE is_rejected) AS rejected,
 CAST(sum(epoch(confirmed_at) - epoch(created_at)) / 3600.0 AS DOUBLE) / nullif(count(confirmed_at), 0) AS hours_to_confirm FROM orders_in o JOIN f ON o.order_id = f.order_id WHERE payment_type <> 'PREPAID' GROUP BY 1, 2)
SELECT *, confirmed / nullif(eligible, 0) AS confirmation_rate FROM c""")
def ops_confirmation(spark, sf_dir):
    o = commerce.orders(spark, sf_dir).filter("payment_type <> 'PREPAID'").withColumn("cohort", zone_day("created_at")).drop("business_id")
    hours = (F.unix_timestamp(F.col("confirmed_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600.0
    c = o.join(flags(spark, sf_dir), "order_id").groupBy("business_id", "cohort").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("is_confirmed").alias("confirmed"), F.count_if("is_rejected").alias("rejected"), F.avg(hours.cast("double")).alias("hours_to_confirm"))
    return c.withColumn("confirmation_rate", ratio("confirmed", "eligible"))


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT business_id, courier, order_id, bool_or(status = 'SHIPPED') AS s, bool_or(status = 'DELIVERED') AS d, bool_or(status = 'RETURNED') AS r, count(*) FILTER (WHERE status = 'DELIVERY_ATTEMPTED') AS a FROM op_events WHERE courier IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT business_id, courier, count(*) FILTER (WHERE s) AS shipped, count(*) FILTER (WHERE s AND d) AS delivered, count(*) FILTER (WHERE s AND d AND r) AS returned, CAST(sum(a) AS BIGINT) AS attempts FROM f GROUP BY 1, 2)
SELECT *, delivered / nullif(shipped, 0) AS delivery_rate, returned / nullif(delivered, 0) AS return_rate, attempts / nullif(shipped, 0) AS attempts_per_shipped FROM g""")
def ops_delivery(spark, sf_dir):
    is_ = lambda s: F.bool_or(F.col("status") == s)
    f = events(spark, sf_dir).filter("courier is not null").groupBy("business_id", "courier", "order_id").agg(is_("SHIPPED").alias("s"), is_("DELIVERED").alias("d"), is_("RETURNED").alias("r"), F.count_if(F.col("status") == "DELIVERY_ATTEMPTED").alias("a"))
    g = f.groupBy("business_id", "courier").agg(F.count_if("s").alias("shipped"), F.count_if(F.expr("s and d")).alias("delivered"), F.count_if(F.expr("s and d and r")).alias("returned"), F.sum("a").cast("long").alias("attempts"))
    return g.withColumns({"delivery_rate": ratio("delivered", "shipped"), "return_rate": ratio("returned", "delivered"), "attempts_per_shipped": ratio("attempts", "shipped")})


@query(f"""WITH {CURRENT_SQL}, g AS (SELECT o.business_id, currency, coalesce(CAST(delivered_at AS DATE), DATE '1970-01-01') AS day, count(*) AS orders, CAST(sum(CAST(order_value AS DECIMAL(18,4))) AS DOUBLE) AS expected, CAST(sum(CAST(cash_collected AS DECIMAL(18,4))) AS DOUBLE) AS collected
FROM orders_in o JOIN current c ON o.order_id = c.order_id WHERE payment_type = 'COD' GROUP BY 1, 2, 3) SELECT *, collected / nullif(expected, 0) AS collection_rate FROM g""")
def ops_collection(spark, sf_dir):
    o = commerce.orders(spark, sf_dir).filter("payment_type = 'COD'").join(current(spark, sf_dir).drop("business_id"), "order_id")
    g = o.groupBy("business_id", "currency", F.coalesce(F.to_date("delivered_at"), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("orders"), money("order_value").alias("expected"), money("cash_collected").alias("collected"))
    return g.withColumn("collection_rate", ratio("collected", "expected"))


_REMIT_SQL = """remittances AS (SELECT concat('rem_', supplier_id, '_', strftime(shipped_at, '%Y%m')) AS remittance_id, concat('courier_', supplier_id % 5) AS courier, CAST(date_trunc('month', shipped_at) AS DATE) AS period_start,
 CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) AS gross, CAST(sum(CAST(price * discount AS DECIMAL(18,4))) AS DOUBLE) AS fees, max(supplier_id % 4 = 0) AS pending FROM lines_in WHERE linestatus = 'F' GROUP BY 1, 2, 3)"""


def remittance_id(day: str) -> Column:
    return F.concat(F.lit("rem_"), "supplier_id", F.lit("_"), F.date_format(day, "yyyyMM"))


def remitted(spark, sf_dir) -> DataFrame:
    """(supplier_id, period_start, gross, fees, pending): what a supplier's month brought."""
    done = commerce.lines(spark, sf_dir).filter("linestatus = 'F'")
    g = done.groupBy("supplier_id", F.to_date(F.date_trunc("month", "shipped_at")).alias("period_start"))
    return g.agg(money("price").alias("gross"), money(F.col("price") * F.col("discount")).alias("fees"), F.max(F.col("supplier_id") % 4 == 0).alias("pending"))


def remittances(spark, sf_dir) -> DataFrame:
    done = commerce.lines(spark, sf_dir).filter("linestatus = 'F'")
    g = done.groupBy(remittance_id("shipped_at").alias("remittance_id"), F.concat(F.lit("courier_"), (F.col("supplier_id") % 5).cast("string")).alias("courier"), F.to_date(F.date_trunc("month", "shipped_at")).alias("period_start"))
    return g.agg(money("price").alias("gross"), money(F.col("price") * F.col("discount")).alias("fees"), F.max(F.col("supplier_id") % 4 == 0).alias("pending"))


@query(f"""WITH {commerce.LINES_SQL}, {_REMIT_SQL} SELECT courier, period_start, count(*) AS remittances, CAST(sum(CAST(gross AS DECIMAL(18,4))) AS DOUBLE) AS gross, CAST(sum(CAST(fees AS DECIMAL(18,4))) AS DOUBLE) AS fees,
 CAST(sum(CAST(CASE WHEN pending THEN 0 ELSE gross END AS DECIMAL(18,4)) - CAST(CASE WHEN pending THEN 0 ELSE fees END AS DECIMAL(18,4))) AS DOUBLE) AS net, CAST(sum(CAST(CASE WHEN pending THEN gross ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) AS pending_gross FROM remittances GROUP BY 1, 2""")
def ops_remittance(spark, sf_dir):
    r = remittances(spark, sf_dir)
    exact = lambda c, keep: F.when(keep, F.col(c)).otherwise(0.0).cast("decimal(18,4)")
    return r.groupBy("courier", "period_start").agg(F.count(F.lit(1)).alias("remittances"), money("gross").alias("gross"), money("fees").alias("fees"), F.sum(exact("gross", ~F.col("pending")) - exact("fees", ~F.col("pending"))).cast("double").alias("net"), F.sum(exact("gross", F.col("pending"))).cast("double").alias("pending_gross"))


_ORDER = "event_at, stage, status, coalesce(shipment_id, '')"
_ALLOWED_SQL = " OR ".join(f"(previous = '{a}' AND status = '{b}')" for a, bs in ALLOWED.items() for b in bs)


def transitions(ev: DataFrame) -> DataFrame:
    """Each event with the one before it in its order and whether it may follow."""
    w = Window.partitionBy("business_id", "order_id").orderBy("event_at", "stage", "status", F.coalesce("shipment_id", F.lit("")))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in ALLOWED.items() for b in bs])
    return ev.withColumn("previous", F.lag("status").over(w)).withColumn("allowed", F.col("previous").isNull() | F.array_contains(pairs, F.concat_ws(">", "previous", "status")))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT *, lag(status) OVER (PARTITION BY business_id, order_id ORDER BY {_ORDER}) AS previous FROM op_events)
SELECT previous, status, count(*) AS n FROM t WHERE previous IS NOT NULL AND NOT ({_ALLOWED_SQL}) GROUP BY 1, 2""")
def ops_transitions(spark, sf_dir):
    return transitions(events(spark, sf_dir)).filter("previous is not null and not allowed").groupBy("previous", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CURRENT_SQL} SELECT business_id, order_id, status, status_at FROM current WHERE status NOT IN ('DELIVERED', 'RETURNED', 'REJECTED') AND status_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR")
def ops_stuck(spark, sf_dir):
    return current(spark, sf_dir).filter("status not in ('DELIVERED', 'RETURNED', 'REJECTED')").filter(F.col("status_at") < F.expr(f"timestamp_ntz '{AS_OF}' - interval 48 hours")).select("business_id", "order_id", "status", "status_at")


@query(f"WITH {CURRENT_SQL} SELECT business_id, status, count(*) AS orders, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(CAST(cash_collected AS DECIMAL(18,4))) AS DOUBLE) AS cash FROM current GROUP BY 1, 2")
def ops_overview(spark, sf_dir):
    return current(spark, sf_dir).groupBy("business_id", "status").agg(F.count(F.lit(1)).alias("orders"), F.sum("attempts").cast("long").alias("attempts"), money("cash_collected").alias("cash"))
