"""All findings of operations and economics over canonical tables that are made from orders and lines, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import issues
from tradewind.plans.lifecycle import STAGES, STATUSES, allowed_pairs
from tradewind.plans.registry import query, table

_BIZ = "case when {k} % 211 = 0 then null else concat('biz_', {k} % 3) end"
_STATUS = "case (l_partkey * 31 + l_linenumber) % 20 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATUSES)) + " end"
_LINE, _LINE_ID = _BIZ.format(k="l_orderkey"), "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey)"
#: Canonical tables: (source, {column: expression}); the faults are those that the checks name.
TABLES = {
    "commerce_orders": ("orders", {"business_id": _BIZ.format(k="o_orderkey"), "order_id": "case when o_orderkey % 97 = 0 then -o_orderkey else o_orderkey end"}),
    "operational_events": ("lineitem", {
        "business_id": _LINE, "source_id": "'src'", "provider": "case when l_partkey % 199 = 0 then '' else 'p' end", "event_id": f"case when l_partkey % 103 = 0 then 'same' else {_LINE_ID} end", "order_id": "l_orderkey",
        "canonical_status": _STATUS, "event_at": "l_shipdate", "revision": "l_linenumber", "corrects_event_id": "case when l_suppkey % 13 = 0 then 'earlier' end",
    }),
    "shipments": ("lineitem", {"business_id": _LINE, "order_id": "case when l_suppkey % 89 = 0 then -1 else l_orderkey end", "shipment_id": "concat(l_orderkey, '/', l_suppkey)", "shipped_at": "l_shipdate", "delivered_at": "l_shipdate + interval 1 day * cast(l_quantity - 5 as int)"}),
    "cash_collections": ("lineitem", {
        "business_id": _LINE, "order_id": "l_orderkey", "shipment_id": "case when l_partkey % 61 = 0 then 'none' when l_partkey % 59 = 0 then '' else concat(l_orderkey, '/', l_suppkey) end",
        "remittance_id": "case when l_partkey % 7 = 0 then concat('r', l_suppkey % 50) end", "cash_expected": "l_extendedprice", "cash_collected": "case when l_partkey % 83 = 0 then -1.0 when l_partkey % 5 = 0 then 0.0 else l_extendedprice end",
    }),
    "remittances": ("supplier", {
        "business_id": "concat('biz_', s_suppkey % 3)", "remittance_id": "concat('r', s_suppkey % 40)", "currency": "case when s_suppkey % 9 = 0 then null else 'USD' end", "gross_collected": "s_acctbal",
        "provider_fees": "1.0", "shipping_fees": "0.0", "cod_fees": "cast(null as double)", "net_remitted": "case when s_suppkey % 4 = 0 then s_acctbal + 1 else s_acctbal - 1 end",
    }),
    "product_costs": ("lineitem", {
        "business_id": _LINE, "source_id": "'src'", "product_id": "l_partkey % 50", "variant_id": "cast(null as string)", "sku": "'sku'", "currency": "case when l_suppkey % 2 = 0 then 'USD' else 'EUR' end",
        "cost_record_id": f"case when l_partkey % 107 = 0 then '' else {_LINE_ID} end", "external_record_id": "l_suppkey", "unit_cogs": "l_tax - 0.001",
        "valid_from": "cast(l_shipdate as date)", "valid_to": "case when l_partkey % 401 = 0 then cast(l_shipdate as date) - interval 3 day else cast(l_shipdate as date) end",
    }),
    "cost_components": ("lineitem", {"business_id": _LINE, "order_id": "case when l_partkey % 71 = 0 then null else l_orderkey end", "shipment_id": "''", "remittance_id": "cast(null as string)", "product_id": "cast(null as string)", "variant_id": "''", "sku": "''", "cost_component_id": _LINE_ID, "amount": "l_discount - 0.005"}),
    "attribution_links": ("lineitem", {
        "business_id": _LINE, "source_id": "'src'", "provider": "'p'", "external_record_id": "concat(l_orderkey, '-', l_linenumber % 4)", "order_id": "l_orderkey", "attribution_link_id": f"case when l_partkey % 109 = 0 then null else {_LINE_ID} end",
        "revision": "l_linenumber", "attribution_weight": "case when l_partkey % 67 = 0 then -0.25 when l_partkey % 73 = 0 then 1.5 else 0.25 end",
    }),
    "order_economics": ("orders", {
        "business_id": _BIZ.format(k="o_orderkey"), "order_id": "o_orderkey", "cogs_complete": "o_orderkey % 6 <> 0", "has_marketing_attribution": "o_orderkey % 4 = 0", "currency_compatible": "o_custkey % 5 <> 0",
        "net_remitted": "case when o_orderkey % 31 = 0 then o_totalprice + 1 else o_totalprice end", "gross_collected": "o_totalprice", "cash_expected": "case when o_custkey % 7 = 0 then 0.0 else o_totalprice end",
        "cash_collected": "case when o_custkey % 11 = 0 then o_totalprice + 5 else o_totalprice end", "recognized_economic_value": "o_totalprice", "variable_operational_cost": "10.0",
        "contribution_before_marketing": "case when o_orderkey % 37 = 0 then null when o_orderkey % 41 = 0 then o_totalprice else o_totalprice - 10.0 end", "delivered_order_value": "o_totalprice",
    }),
    "business_economics_cohort": ("orders", {"delivered_order_value": "case when o_orderkey % 1000 = 1 then o_totalprice + 1 else o_totalprice end"}),
}


def canonical(spark, sf_dir, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names)


def _sql(code: str, severity: str, rows: str, order: str = "business_id, CAST(order_id AS VARCHAR) AS order_id", n: str = "1") -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, {order}, {n} AS n FROM {rows}"


_NONE = "business_id, NULL AS order_id"
_SUM = "SELECT code, severity, business_id, count(DISTINCT order_id) AS orders, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY 1, 2, 3"
_BLANK = "coalesce(CAST({} AS VARCHAR), '') = ''"
_REPEATED = "(SELECT business_id, order_id, row_number() OVER (PARTITION BY {0} ORDER BY business_id NULLS FIRST, CAST(order_id AS VARCHAR) NULLS FIRST) AS k FROM {1}) WHERE k > 1"
_ORDERED = "event_at, revision, stage, event_id, canonical_status, corrects_event_id NULLS FIRST"


def _any(columns: list[str]) -> str:
    return " OR ".join(_BLANK.format(c) for c in columns)


def _absent(rows: str, parent: str, *keys: str) -> str:
    return f"{rows} WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {' AND '.join(f'p.{k} IS NOT DISTINCT FROM c.{k}' for k in keys)})"


_OPERATIONS_SQL = " UNION ALL ".join([
    _sql("event_identity_incomplete", "CRITICAL", f"operational_events WHERE {_any(['business_id', 'source_id', 'provider', 'event_id', 'order_id', 'canonical_status'])}"),
    _sql("duplicate_event", "CRITICAL", _REPEATED.format("event_id", "operational_events")),
    _sql("orphan_event", "CRITICAL", _absent("operational_events c", "commerce_orders", "business_id", "order_id")),
    _sql("invalid_status_transition", "WARNING", "(SELECT * FROM moved LEFT JOIN moves ON a = previous AND b = canonical_status WHERE previous IS NOT NULL AND corrects_event_id IS NULL AND a IS NULL)"),
    _sql("delivered_before_shipped", "CRITICAL", "(SELECT business_id, order_id, min(event_at) FILTER (WHERE canonical_status = 'SHIPPED') AS s, min(event_at) FILTER (WHERE canonical_status = 'DELIVERED') AS d FROM operational_events GROUP BY 1, 2) WHERE d < s"),
    _sql("orphan_shipment", "CRITICAL", _absent("shipments c", "commerce_orders", "business_id", "order_id")),
    _sql("shipment_timestamp_order", "CRITICAL", "shipments WHERE delivered_at < shipped_at"),
    _sql("negative_collection_amount", "CRITICAL", "cash_collections WHERE cash_expected < 0 OR cash_collected < 0"),
    _sql("orphan_collection_shipment", "CRITICAL", _absent("(SELECT * FROM cash_collections WHERE shipment_id <> '') c", "shipments", "business_id", "shipment_id")),
    _sql("cash_without_delivery", "WARNING", _absent("(SELECT * FROM cash_collections WHERE cash_collected > 0) c", "(SELECT * FROM operational_events WHERE canonical_status = 'DELIVERED')", "business_id", "order_id")),
    _sql("orphan_collection_remittance", "WARNING", _absent("(SELECT * FROM cash_collections WHERE remittance_id <> '') c", "remittances", "business_id", "remittance_id")),
    _sql("remittance_currency_missing", "CRITICAL", f"remittances WHERE {_BLANK.format('currency')}", _NONE),
    _sql("negative_remittance_amount", "CRITICAL", "remittances WHERE gross_collected < 0 OR provider_fees < 0 OR net_remitted < 0", _NONE),
    _sql("net_above_gross", "WARNING", "remittances WHERE net_remitted > gross_collected", _NONE),
])
_STAGE = {s: k for k, group in enumerate(STAGES) for s in group}


@query(f"""WITH {_with('commerce_orders', 'operational_events', 'shipments', 'cash_collections', 'remittances')}, moves(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in allowed_pairs())}),
staged AS (SELECT *, CASE canonical_status {' '.join(f"WHEN '{s}' THEN {k}" for s, k in _STAGE.items())} END AS stage FROM operational_events),
moved AS (SELECT *, lag(canonical_status) OVER (PARTITION BY business_id, order_id ORDER BY {_ORDERED}) AS previous FROM staged),
found AS ({_OPERATIONS_SQL}) {_SUM}""")
def dq_operations_findings(spark, sf_dir):
    """All fourteen checks, by tenant."""
    names = ("commerce_orders", "operational_events", "shipments", "cash_collections", "remittances")
    found = issues.operations_issues({n: canonical(spark, sf_dir, n) for n in names}, allowed_pairs(), _STAGE)
    return found.groupBy("code", "severity", "business_id").agg(F.count_distinct("order_id").alias("orders"), F.sum("n").alias("n"))


_SUBJECT = "business_id, source_id, product_id, variant_id, sku, currency"
_ECONOMICS_SQL = " UNION ALL ".join([
    *[s for t, i, o in (("product_costs", "cost_record_id", _NONE), ("cost_components", "cost_component_id", "business_id, CAST(order_id AS VARCHAR) AS order_id"), ("attribution_links", "attribution_link_id", "business_id, CAST(order_id AS VARCHAR) AS order_id")) for s in (
        _sql("economic_identity_incomplete", "CRITICAL", f"{t} WHERE {_any(['business_id', i])}", o),
        _sql("duplicate_economic_record", "CRITICAL", _REPEATED.format(i, t if t != "product_costs" else "(SELECT *, NULL AS order_id FROM product_costs)"), o),
    )],
    _sql("negative_cogs", "CRITICAL", "product_costs WHERE unit_cogs < 0", _NONE),
    _sql("invalid_cost_effective_range", "CRITICAL", "product_costs WHERE valid_to < valid_from", _NONE),
    _sql("overlapping_product_costs", "WARNING", "swept WHERE last.b >= a", _NONE),
    _sql("negative_variable_cost", "CRITICAL", "cost_components WHERE amount < 0"),
    _sql("cost_subject_missing", "CRITICAL", "cost_components WHERE order_id IS NULL"),
    _sql("invalid_attribution_weight", "CRITICAL", "links WHERE weight < 0 OR weight > 1"),
    _sql("attribution_weight_above_one", "CRITICAL", "(SELECT business_id, order_id, sum(CAST(weight AS DECIMAL(28,12))) AS w FROM links GROUP BY 1, 2) WHERE w > 1.000000001"),
    _sql("missing_cogs", "WARNING", "order_economics WHERE NOT cogs_complete"),
    _sql("marketing_commerce_currency_mismatch", "WARNING", "order_economics WHERE has_marketing_attribution AND NOT currency_compatible"),
    _sql("net_remitted_above_gross", "CRITICAL", "order_economics WHERE net_remitted > gross_collected + 1e-8"),
    _sql("cash_collected_above_expected", "WARNING", "order_economics WHERE cash_expected > 0 AND cash_collected > cash_expected + 1e-8"),
    _sql("contribution_formula_mismatch", "CRITICAL", "order_economics WHERE cogs_complete AND (contribution_before_marketing IS NULL OR abs(contribution_before_marketing - (recognized_economic_value - variable_operational_cost)) > 1e-8)"),
    _sql("fanout_reconciliation_failed", "CRITICAL", "(SELECT (SELECT coalesce(sum(CAST(delivered_order_value AS DECIMAL(28,8))), 0) FROM order_economics) - (SELECT coalesce(sum(CAST(delivered_order_value AS DECIMAL(28,8))), 0) FROM business_economics_cohort) AS gap) WHERE abs(gap) > 1e-8", "NULL AS business_id, NULL AS order_id"),
])


@query(f"""WITH {_with('product_costs', 'cost_components', 'attribution_links', 'order_economics', 'business_economics_cohort')},
links AS (SELECT business_id, order_id, attribution_weight AS weight FROM (SELECT *, row_number() OVER (PARTITION BY business_id, source_id, provider, external_record_id ORDER BY revision DESC, attribution_weight, order_id DESC) AS k FROM attribution_links) WHERE k = 1),
good AS (SELECT {_SUBJECT}, external_record_id AS record, valid_from AS a, CAST(valid_to AS DATE) AS b FROM product_costs WHERE valid_from <= valid_to),
own AS (SELECT *, max(b) OVER (PARTITION BY {_SUBJECT}, record ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM good),
part AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {_SUBJECT}, record ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM own),
whole AS (SELECT {_SUBJECT}, record, min(a) AS a, max(b) AS b FROM part GROUP BY {_SUBJECT}, record, k),
swept AS (SELECT *, max({{'b': b, 'r': record}}) OVER (PARTITION BY {_SUBJECT} ORDER BY a, record, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM whole),
found AS ({_ECONOMICS_SQL}) {_SUM}""")
def dq_economics_findings(spark, sf_dir):
    """All fifteen checks, by tenant."""
    silver, gold = ("product_costs", "cost_components", "attribution_links"), ("order_economics", "business_economics_cohort")
    found = issues.economics_issues({n: canonical(spark, sf_dir, n) for n in silver}, {n: canonical(spark, sf_dir, n) for n in gold})
    return found.groupBy("code", "severity", "business_id").agg(F.count_distinct("order_id").alias("orders"), F.sum("n").alias("n"))
