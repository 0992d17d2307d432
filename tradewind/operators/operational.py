"""Operational records in canonical form: providers' statuses by role, and the invariants of each kind of record as codes.

A record isn't refused where it is read: it carries its codes, in a fixed order, and is routed by
them. Null conditions don't hold unless a code is about what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.core import errors

#: Canonical status of each provider's status, by role; fixed values of the providers' contract.
STATUSES: dict[str, dict[str, str]] = {
    "commerce_orders": {"new": "CREATED", "awaiting_confirmation": "PENDING_CONFIRMATION", "cancelled_by_merchant": "CANCELLED"},
    "confirmation_events": {
        "queued": "PENDING_CONFIRMATION", "customer_confirmed": "CONFIRMED", "customer_rejected": "REJECTED_CONFIRMATION", "customer_not_answering": "UNREACHABLE",
        "duplicate_order": "REJECTED_CONFIRMATION", "fraud_flag": "REJECTED_CONFIRMATION", "invalid": "REJECTED_CONFIRMATION", "cancelled": "CANCELLED",
    },
    "fulfillment_events": {"ready": "READY_FOR_FULFILLMENT", "packed": "FULFILLED", "handed_to_carrier": "SHIPPED"},
    "delivery_events": {
        "moving": "IN_TRANSIT", "vehicle_out": "OUT_FOR_DELIVERY", "attempted": "DELIVERY_ATTEMPTED", "customer_not_answering": "UNREACHABLE", "customer_refused": "REFUSED",
        "new_date_requested": "RESCHEDULED", "parcel_delivered": "DELIVERED", "return_started": "RETURN_IN_TRANSIT", "returned_to_sender": "RETURNED_TO_ORIGIN",
    },
    "cod_collections": {"cash_received": "CASH_COLLECTED", "awaiting_settlement": "REMITTANCE_PENDING"},
    "remittances": {"pending": "REMITTANCE_PENDING", "paid": "REMITTED", "partial": "REMITTANCE_PENDING", "cancelled": "REMITTANCE_PENDING"},
}
#: Outcome of a confirmation by the provider's status; fixed values.
OUTCOMES = {
    "queued": "pending", "customer_confirmed": "confirmed", "customer_rejected": "rejected", "customer_not_answering": "customer_unreachable",
    "duplicate_order": "duplicate", "fraud_flag": "fraud_suspected", "cancelled": "cancelled", "invalid": "invalid_order",
}
SLUG, CURRENCY = "^[a-z0-9][a-z0-9_-]{2,63}$", "^[A-Z]{3}$"


def pairs() -> dict[tuple[str, str], str]:
    """STATUSES as {(role, provider's status): status}, for canonical.map_status."""
    return {(role, s): c for role, table in STATUSES.items() for s, c in table.items()}


def outcome(status: str = "provider_status") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), F.lower(F.trim(F.col(status))))


def _missing(*columns: str) -> Column:
    return reduce(lambda a, c: a | F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).eqNullSafe(""), columns, F.lit(False))


def _not(pattern: str, c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def _amounts(columns: Sequence[str], below: bool = True) -> list[tuple[Column, str]]:
    """An amount must be there and finite, and not below nought unless it may be."""
    out = []
    for c in columns:
        odd = F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        out.append((odd | (F.col(c) < 0) if below else odd, f"invalid_{c}"))
    return out


def _quantities(c: str = "line_quantities") -> tuple[Column, str]:
    """A map of line to quantity: whole numbers above nought under names."""
    bad = F.exists(F.map_entries(c), lambda e: F.coalesce(F.trim(e["key"]), F.lit("")).eqNullSafe("") | e["value"].isNull() | (e["value"] <= 0))
    return F.coalesce(bad, F.lit(False)), "invalid_line_quantities"


def invariants(kind: str) -> Column:
    """Codes of the broken invariants of a record's kind."""
    checks = {
        "order_line": [(_missing("order_id", "line_id"), "missing_identity"), (F.coalesce(F.col("quantity") <= 0, F.lit(True)), "non_positive_quantity"), *_amounts(["unit_price"]), (_not(CURRENCY, "currency"), "invalid_currency")],
        "commerce_order": [
            (_not(SLUG, "business_id") | _missing("order_id"), "missing_identity"), (F.col("order_created_at").isNull() | F.col("order_updated_at").isNull(), "missing_time"),
            (F.col("order_updated_at") < F.col("order_created_at"), "updated_before_created"), *_amounts(["order_value"]), (_not(CURRENCY, "currency"), "invalid_currency"),
            (~F.coalesce(F.col("payment_type").isin("cod", "prepaid", "mixed", "other"), F.lit(False)), "invalid_payment_type"),
        ],
        "operational_event": [
            (_missing("provider", "event_id", "external_event_id", "order_id", "provider_status"), "missing_identity"), (F.coalesce(F.col("revision") < 1, F.lit(True)), "invalid_revision"),
            (F.col("event_at").isNull() | F.col("received_at_utc").isNull(), "missing_time"),
        ],
        "fulfillment": [(_missing("business_id", "order_id", "fulfillment_id", "provider"), "missing_identity"), _quantities()],
        "shipment": [(_missing("business_id", "order_id", "fulfillment_id", "shipment_id", "provider"), "missing_identity"), (F.col("delivered_at") < F.col("shipped_at"), "delivered_before_shipped"), _quantities()],
        "delivery_attempt": [(_missing("event_id"), "missing_identity"), (F.coalesce(F.col("attempt_number") < 1, F.lit(True)), "invalid_attempt_number")],
        "cash_collection": [(_missing("business_id", "collection_id", "order_id"), "missing_identity"), *_amounts(["cash_expected", "cash_collected"]), (_not(CURRENCY, "collection_currency"), "invalid_currency")],
        "remittance": [
            (_missing("business_id", "remittance_id"), "missing_identity"), (F.coalesce(F.col("period_end") < F.col("period_start"), F.lit(True)), "period_ends_before_start"), (_not(CURRENCY, "currency"), "invalid_currency"),
            *_amounts(["gross_collected", "provider_fees", "shipping_fees", "cod_fees", "net_remitted"]), *_amounts(["adjustments"], below=False),
            (~F.coalesce(F.col("settlement_status").isin("pending", "remitted", "partial", "cancelled"), F.lit(False)), "invalid_settlement_status"),
        ],
    }
    return errors(*checks[kind])


def checked(df: DataFrame, kind: str, name: str = "record_errors") -> DataFrame:
    return df.withColumn(name, invariants(kind))
