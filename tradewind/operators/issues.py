"""Checks of whole data sets: each finding with its code, severity, tenant and order, and how often it stands.

Findings are (code, severity, business_id, order_id, n). Checks of single rows share one pass a
table; those between tables are anti joins, those over histories and intervals are sweeps over
pieces (ordered.py), so no check gathers a group. Null conditions don't hold, empty tables have
no findings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ordered import previous
from tradewind.operators.relational import conflicts
from tradewind.session import landed

CRITICAL, WARNING = "CRITICAL", "WARNING"
#: Amounts may be off by so much.
NEAR = 1e-8


def _out(df: DataFrame, code: str, severity: str, n: Column | None = None) -> DataFrame:
    have = lambda c: F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), have("business_id"), have("order_id"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def row_checks(df: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Findings of conditions on single rows, in one pass."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, cond in checks]))
    x = df.withColumn("__found", F.explode(found))
    have = lambda c: F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    return x.select("__found.code", "__found.severity", have("business_id"), have("order_id"), F.lit(1).cast("long").alias("n"))


def repeated(df: DataFrame, identity: str, code: str, severity: str) -> DataFrame:
    """Rows beyond the first of an identity, null ones included; the first is of the least tenant and order.

    Most identities stand once: hashes of them alone are dealt and counted, and only rows whose
    hash stands more than once are compared whole.
    """
    groups = df.select(F.col(identity).alias("__id"), F.col("business_id").cast("string"), (F.col("order_id") if "order_id" in df.columns else F.lit(None)).cast("string").alias("order_id"), F.xxhash64(identity).alias("__mark"))
    often = landed(groups.groupBy("__mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__mark"), "repeated-marks")
    n = groups.join(often, "__mark", "left_semi").groupBy("__id", "business_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
    first = n.groupBy("__id").agg(F.min(F.struct("business_id", "order_id")).alias("__first"))
    own = first.withColumnRenamed("__id", "__of")
    met = n.join(own, F.col("__id").eqNullSafe(F.col("__of")))
    rest = met.withColumn("n", F.col("n") - F.struct("business_id", "order_id").eqNullSafe(F.col("__first")).cast("int")).filter("n > 0")
    return _out(rest, code, severity, F.col("n"))


def missing(df: DataFrame, keys: Sequence[str], parent: DataFrame, code: str, severity: str) -> DataFrame:
    """Rows whose keys no parent has; null keys match null keys. Rows that agree in keys and order are one finding with their number."""
    # keys as one column that is never null: parents, once distinct, and rows, once counted, lie as the join needs them
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    own = parent.select(key.alias("__of")).distinct()
    if "order_id" in keys and "business_id" in keys:
        child = df.select(key.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
        named = {k: F.col(f"__key.k{i}") for i, k in enumerate(keys)}
        left = child.join(own, F.col("__key") == F.col("__of"), "left_anti").withColumns(named)
        return _out(left, code, severity, F.col("n"))
    left = df.select("business_id", "order_id", key.alias("__key")).join(own, F.col("__key") == F.col("__of"), "left_anti")
    return _out(left, code, severity)


def _blank(*columns: str) -> Column:
    return reduce(lambda a, c: a | F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(""), columns, F.lit(False))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def operations_issues(silver: Mapping[str, DataFrame], moves: Sequence[tuple[str, str]], stage: Mapping[str, int]) -> DataFrame:
    """Findings over commerce_orders, operational_events, shipments, cash_collections and remittances.

    moves: pairs of statuses that may follow each other, stage: a status's place among those of
    one instant. A move that corrects an earlier event may be any.
    """
    orders, events, shipments, cash, paid = (silver[t] for t in ("commerce_orders", "operational_events", "shipments", "cash_collections", "remittances"))
    key = ["business_id", "order_id"]
    out = [row_checks(events, [("event_identity_incomplete", CRITICAL, _blank("business_id", "source_id", "provider", "event_id", "order_id", "canonical_status"))])]
    out.append(repeated(events, "event_id", "duplicate_event", CRITICAL))
    out.append(missing(events, key, orders, "orphan_event", CRITICAL))

    place = F.create_map(*[F.lit(x) for kv in stage.items() for x in kv])[F.col("canonical_status")]
    order = ["event_at", "revision", "stage", "event_id", "canonical_status", "corrects_event_id"]
    known = events.filter(place.isNotNull()).withColumn("revision", F.coalesce("revision", F.lit(1))).withColumn("stage", place).select(*key, *order)
    rows = previous(known, key, order, "canonical_status", "previous")
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in moves])
    odd = F.col("previous").isNotNull() & F.col("corrects_event_id").isNull() & ~F.array_contains(pairs, F.concat_ws(">", "previous", "canonical_status"))
    out.append(_out(rows.filter(odd), "invalid_status_transition", WARNING))
    first = lambda s: F.min(F.when(F.col("canonical_status") == s, F.col("event_at")))
    times = known.groupBy(*key).agg(first("SHIPPED").alias("shipped"), first("DELIVERED").alias("delivered"))
    out.append(_out(times.filter("delivered < shipped"), "delivered_before_shipped", CRITICAL))

    out.append(missing(shipments, key, orders, "orphan_shipment", CRITICAL))
    out.append(row_checks(shipments, [("shipment_timestamp_order", CRITICAL, F.col("delivered_at") < F.col("shipped_at"))]))
    nought = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out.append(row_checks(cash, [("negative_collection_amount", CRITICAL, F.least(nought("cash_expected"), nought("cash_collected")) < 0)]))
    out.append(missing(cash.filter(~_blank("shipment_id")), ["business_id", "shipment_id"], shipments, "orphan_collection_shipment", CRITICAL))
    out.append(missing(cash.filter("cash_collected > 0"), key, events.filter("canonical_status = 'DELIVERED'"), "cash_without_delivery", WARNING))
    out.append(missing(cash.filter(~_blank("remittance_id")), ["business_id", "remittance_id"], paid, "orphan_collection_remittance", WARNING))
    low = reduce(lambda a, c: a | (nought(c) < 0), ("gross_collected", "provider_fees", "shipping_fees", "cod_fees", "net_remitted"), F.lit(False))
    out.append(row_checks(paid, [("remittance_currency_missing", CRITICAL, _blank("currency")), ("negative_remittance_amount", CRITICAL, low), ("net_above_gross", WARNING, nought("net_remitted") > nought("gross_collected"))]))
    return _union(out)


def economics_issues(silver: Mapping[str, DataFrame], gold: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Findings over product_costs, cost_components and attribution_links, and over order_economics against business_economics_cohort.

    Product costs of one subject conflict if a separate record overlaps one that begins before it;
    the finding is the later one's, once. Of an attribution link only the latest revision counts,
    of equal ones the least weight.
    """
    costs, parts, links = (silver[t] for t in ("product_costs", "cost_components", "attribution_links"))
    out = []
    for df, identity in ((costs, "cost_record_id"), (parts, "cost_component_id"), (links, "attribution_link_id")):
        out += [row_checks(df, [("economic_identity_incomplete", CRITICAL, _blank("business_id", identity))]), repeated(df, identity, "duplicate_economic_record", CRITICAL)]
    out.append(row_checks(costs, [("negative_cogs", CRITICAL, F.col("unit_cogs") < 0), ("invalid_cost_effective_range", CRITICAL, F.col("valid_to") < F.col("valid_from"))]))
    subject = ["business_id", "source_id", "product_id", "variant_id", "sku", "currency"]
    out.append(_out(conflicts(costs, subject, "external_record_id"), "overlapping_product_costs", WARNING))
    no_subject = ~reduce(lambda a, c: a | ~_blank(c), ("order_id", "shipment_id", "remittance_id", "product_id", "variant_id", "sku"), F.lit(False))
    out.append(row_checks(parts, [("negative_variable_cost", CRITICAL, F.col("amount") < 0), ("cost_subject_missing", CRITICAL, no_subject)]))
    last = links.groupBy("business_id", "source_id", "provider", "external_record_id").agg(F.max(F.struct("revision", (-F.col("attribution_weight")).alias("less"), "order_id")).alias("x"))
    last = last.select("business_id", F.col("x.order_id").alias("order_id"), (-F.col("x.less")).alias("weight"))
    out.append(row_checks(last, [("invalid_attribution_weight", CRITICAL, (F.col("weight") < 0) | (F.col("weight") > 1))]))
    whole = last.groupBy("business_id", "order_id").agg(F.sum(F.col("weight").cast("decimal(28,12)")).alias("weight"))
    out.append(_out(whole.filter("weight > 1.000000001"), "attribution_weight_above_one", CRITICAL))
    if gold:
        orders = gold["order_economics"]
        expected = F.col("recognized_economic_value") - F.col("variable_operational_cost")
        out.append(row_checks(orders, [
            ("missing_cogs", WARNING, ~F.col("cogs_complete")),
            ("marketing_commerce_currency_mismatch", WARNING, F.col("has_marketing_attribution") & ~F.col("currency_compatible")),
            ("net_remitted_above_gross", CRITICAL, F.col("net_remitted") > F.col("gross_collected") + NEAR),
            ("cash_collected_above_expected", WARNING, (F.col("cash_expected") > 0) & (F.col("cash_collected") > F.col("cash_expected") + NEAR)),
            ("contribution_formula_mismatch", CRITICAL, F.col("cogs_complete") & (F.col("contribution_before_marketing").isNull() | (F.abs(F.col("contribution_before_marketing") - expected) > NEAR))),
        ]))
        total = lambda df: df.agg(F.coalesce(F.sum(F.col("delivered_order_value").cast("decimal(28,8)")), F.lit(0)).alias("v"))
        both = total(orders).crossJoin(total(gold["business_economics_cohort"]).withColumnRenamed("v", "w"))  # a row each
        out.append(_out(both.filter(F.abs(F.col("v") - F.col("w")) > NEAR), "fanout_reconciliation_failed", CRITICAL))
    return _union(out)
