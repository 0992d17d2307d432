"""Ordered histories: incidents by a fold over occurrences and commands, and orders by a state machine of twenty statuses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import alerts, operational
from tradewind.operators.canonical import map_status
from tradewind.operators.ordered import Machine, run_machine
from tradewind.plans.registry import query, table

#: Half of all occurrences and commands belong to one key; a fifth of the occurrences arrive again, some with newer evidence.
_HOT = "case when {id} % 2 = 0 then 'hot' else concat({kind}, '/', {n} % 10) end"
_OCC = {
    "key": _HOT.format(id="event_id", kind="event_type", n="user_id"), "occurrence_id": "event_id", "seen_at": "ts - interval 1 hour * (event_id % 3)",
    "severity": "case when value > 80 then 'CRITICAL' when value > 40 then 'WARNING' else 'INFO' end", "evidence": "value", "at": "ts", "number": "event_id",
}
_AGAIN = {**_OCC, "severity": "case when event_id % 50 = 0 then 'CRITICAL' else 'INFO' end", "evidence": "-value", "seen_at": "ts + interval 1 hour * (event_id % 4)", "at": "ts + interval 1 hour * (event_id % 72)", "number": "event_id + 1000000000", "key": f"case when event_id % 35 = 0 then 'elsewhere' else {_OCC['key']} end"}
_KINDS = "case o_custkey % 5 when 0 then 'error' when 1 then 'click' when 2 then 'view' when 3 then 'signup' else 'purchase' end"
_COMMANDS = {
    "key": _HOT.format(id="o_orderkey", kind=_KINDS, n="o_custkey"), "target": "case o_orderstatus when 'F' then 'RESOLVED' when 'O' then 'ACKNOWLEDGED' else 'CLOSED' end",
    "by": "case when o_orderkey % 11 = 0 then ' ' else concat('user ', o_custkey % 7) end", "at": "{start} + interval 1 second * (o_orderkey * 7919 % 2592000)", "number": "o_orderkey",
}
_SPARK_START, _SQL_START = "timestamp_ntz '2024-01-01'", "TIMESTAMP '2024-01-01'"


def _cols(exprs: dict, sql: bool = False) -> list[str]:
    start = _SQL_START if sql else _SPARK_START
    return [f"{e.replace('{start}', start)} as {'actor' if sql and n == 'by' else f'"{n}"' if sql else n}" for n, e in exprs.items()]


_INCIDENTS_SQL = f"""given AS (SELECT {', '.join(_cols(_OCC, True))} FROM events UNION ALL SELECT {', '.join(_cols(_AGAIN, True))} FROM events WHERE event_id % 5 = 0),
receipts AS (SELECT occurrence_id, arg_min(key, {{'a': "at", 'n': number}}) AS own_key, min({{'a': "at", 'n': number}}) AS first FROM given GROUP BY 1),
occ AS (SELECT g.*, CASE WHEN {{'a': "at", 'n': number}} = first THEN 'new' ELSE 'replay' END AS kind FROM given g JOIN receipts USING (occurrence_id) WHERE key = own_key),
cmd AS (SELECT * FROM (SELECT {', '.join(_cols(_COMMANDS, True))} FROM orders) WHERE target IN ('ACKNOWLEDGED', 'RESOLVED') AND length(trim(actor)) > 0),
log AS (SELECT key, "at", 0 AS turn, number, kind, occurrence_id, seen_at, severity, evidence, NULL AS actor FROM occ
        UNION ALL SELECT key, "at", 1, number, target, NULL, NULL, NULL, NULL, trim(actor) FROM cmd),
marked AS (SELECT *, last_value(CASE WHEN kind IN ('new', 'RESOLVED') THEN kind END IGNORE NULLS) OVER w = 'new' AS active FROM log WINDOW w AS (PARTITION BY key ORDER BY "at", turn, number, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT *, coalesce(sum((coalesce(active, false) AND kind = 'RESOLVED')::INT) OVER (PARTITION BY key ORDER BY "at", turn, number, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS incident FROM marked),
used AS (SELECT p.* FROM placed p LEFT JOIN placed n ON p.kind = 'replay' AND n.kind = 'new' AND n.occurrence_id = p.occurrence_id
         WHERE p.kind = 'new' OR (p.active AND p.kind IN ('ACKNOWLEDGED', 'RESOLVED')) OR (p.kind = 'replay' AND n.incident = p.incident))"""


@query(f"""WITH {_INCIDENTS_SQL}
SELECT key, CAST(incident AS BIGINT) AS incident, CASE WHEN bool_or(kind = 'RESOLVED') THEN 'RESOLVED' WHEN bool_or(kind = 'ACKNOWLEDGED') THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status,
 count(*) FILTER (WHERE kind = 'new') AS occurrences, count(*) FILTER (WHERE kind = 'replay') AS replays,
 CASE max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity,
 min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(evidence, {{'s': seen_at, 'a': "at", 'n': number}}) FILTER (WHERE kind IN ('new', 'replay')) AS evidence,
 min("at") FILTER (WHERE kind = 'ACKNOWLEDGED') AS acknowledged_at, arg_min(actor, {{'a': "at", 'n': number}}) FILTER (WHERE kind = 'ACKNOWLEDGED') AS acknowledged_by,
 min("at") FILTER (WHERE kind = 'RESOLVED') AS resolved_at, arg_min(actor, {{'a': "at", 'n': number}}) FILTER (WHERE kind = 'RESOLVED') AS resolved_by
FROM used GROUP BY 1, 2""")
def al_incident_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    occ = e.selectExpr(*_cols(_OCC)).unionByName(e.filter("event_id % 5 = 0").selectExpr(*_cols(_AGAIN)))
    return alerts.incident_states(occ, table(spark, sf_dir, "orders").selectExpr(*_cols(_COMMANDS)))


#: The twenty operational statuses by stage; those of a stage stand side by side.
STAGES = [
    ["CREATED"], ["PENDING_CONFIRMATION"], ["CONFIRMED", "REJECTED_CONFIRMATION", "CANCELLED", "UNREACHABLE"], ["READY_FOR_FULFILLMENT"], ["FULFILLED"], ["SHIPPED"], ["IN_TRANSIT"], ["OUT_FOR_DELIVERY"],
    ["DELIVERY_ATTEMPTED", "REFUSED", "RESCHEDULED"], ["DELIVERED", "RETURN_IN_TRANSIT"], ["RETURNED_TO_ORIGIN", "CASH_COLLECTED"], ["REMITTANCE_PENDING"], ["REMITTED"],
]
STATUSES = [s for stage in STAGES for s in stage]
_STAGE = {s: k for k, stage in enumerate(STAGES) for s in stage}
_RETRY = ["DELIVERY_ATTEMPTED", "RESCHEDULED", "IN_TRANSIT", "REFUSED", "OUT_FOR_DELIVERY", "DELIVERED", "RETURN_IN_TRANSIT", "RETURNED_TO_ORIGIN"]
#: What may follow statuses that don't simply go on to the same or a later stage.
FOLLOWS = {
    "REJECTED_CONFIRMATION": [], "CANCELLED": [], "DELIVERED": ["RETURN_IN_TRANSIT", "RETURNED_TO_ORIGIN", "CASH_COLLECTED", "REMITTANCE_PENDING", "REMITTED"],
    "REFUSED": ["RETURN_IN_TRANSIT", "RETURNED_TO_ORIGIN", "DELIVERY_ATTEMPTED", "RESCHEDULED", "DELIVERED"], "UNREACHABLE": _RETRY, "RESCHEDULED": _RETRY, "DELIVERY_ATTEMPTED": _RETRY,
}
#: Ends of a history: nobody is reached any more from shipping on, unless these say otherwise.
_CLOSED = ["REJECTED_CONFIRMATION", "CANCELLED", "DELIVERED", "REFUSED"]


def allowed_pairs() -> list[tuple[str, str]]:
    """All moves of the lifecycle; a status may repeat."""
    onward = {a: [b for b in STATUSES if _STAGE[b] >= _STAGE[a]] for a in STATUSES}
    out = {(a, b) for a in STATUSES for b in [a, *FOLLOWS.get(a, onward[a])]}
    return sorted(out | {(a, "UNREACHABLE") for a in STATUSES if _STAGE[a] >= _STAGE["SHIPPED"] and a not in _CLOSED})


def lifecycle_machine() -> Machine:
    moves = set(allowed_pairs())
    return Machine(np.array([[(a, b) in moves for b in STATUSES] for a in STATUSES]))


def lifecycles(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events (status, correction) with previous, the status they met, and verdict: entered, repeated, corrected, refused or unknown.

    A refused event leaves its history where it was; a correction enters from anywhere; a status
    that isn't one of STATUSES, or null, is unknown and no event. The order within equal values of
    order is by status, then corrections last.
    """
    number = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0)).cast("int")
    x = events.withColumn("target", number).withColumn("free", F.coalesce("correction", F.lit(False)))
    x = run_machine(x, keys, [*order, "status", "free"], lifecycle_machine())
    name = lambda c: F.when(F.col(c) > 0, F.element_at(F.array(*map(F.lit, STATUSES)), F.greatest(F.col(c), F.lit(1))))
    moved = F.when(F.col("target") == 0, "unknown").when(F.col("before") == F.col("target"), "repeated").when(F.col("after") != F.col("target"), "refused").when(F.col("free") & (F.col("before") > 0), "corrected").otherwise("entered")
    return x.select(*events.columns, name("before").alias("previous"), name("after").alias("current"), moved.alias("verdict"))


#: A line of an order as a report of a status; every fiftieth order is part of one long history.
_REPORT = {
    "history": "case when l_orderkey % 50 = 0 then 'one' else concat('order ', l_orderkey) end", "at": "l_shipdate", "number": "l_orderkey * 10 + l_linenumber",
    "code": "cast((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 23 as int)", "correction": "(l_partkey + l_suppkey) % 13 = 0",
}


@query(f"""WITH RECURSIVE names(code, status) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(STATUSES))}), moves(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in allowed_pairs())}),
raw AS (SELECT DISTINCT {', '.join(f'{e} AS "{n}"' for n, e in _REPORT.items())} FROM lineitem),
r AS (SELECT history, status, correction, row_number() OVER (PARTITION BY history ORDER BY "at", number, code, status, correction) AS n FROM raw LEFT JOIN names USING (code)),
fold AS (SELECT history, n, status AS current, CASE WHEN status IS NULL THEN 'unknown' ELSE 'entered' END AS verdict FROM r WHERE n = 1
 UNION ALL SELECT r.history, r.n, CASE WHEN r.status IS NULL THEN f.current WHEN f.current IS NULL OR r.correction OR m.a IS NOT NULL THEN r.status ELSE f.current END,
  CASE WHEN r.status IS NULL THEN 'unknown' WHEN f.current = r.status THEN 'repeated' WHEN f.current IS NULL THEN 'entered' WHEN r.correction THEN 'corrected' WHEN m.a IS NOT NULL THEN 'entered' ELSE 'refused' END
 FROM fold f JOIN r ON r.history = f.history AND r.n = f.n + 1 LEFT JOIN moves m ON m.a = f.current AND m.b = r.status)
SELECT history, arg_max(current, n) AS status, count(*) AS reports, {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ('entered', 'repeated', 'corrected', 'refused', 'unknown'))} FROM fold GROUP BY 1""")
def ops_lifecycle(spark, sf_dir):
    """Final status of each history and what became of its reports."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _REPORT.items()]).distinct()
    status = F.get(F.array(*map(F.lit, STATUSES)), F.col("code"))
    x = lifecycles(raw.withColumn("status", status), ["history"], ["at", "number", "code"])
    last = F.max(F.struct("at", "number", "code", "status", "correction", "current"))["current"]
    return x.groupBy("history").agg(last.alias("status"), F.count(F.lit(1)).alias("reports"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("entered", "repeated", "corrected", "refused", "unknown")])


_ROLES = list(operational.STATUSES)
_WORDS = ["new", " Queued ", "customer_confirmed", "PACKED", "handed_to_carrier", "parcel_delivered", "customer_refused", "cash_received", "paid", "partial", "cancelled", "customer_not_answering", "lost"]
_REPORTED = {
    "role": "case l_linenumber % 6 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_ROLES)) + " end",
    "provider_status": f"case l_partkey % {len(_WORDS)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end",
}


@query(f"""WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _REPORTED.items())} FROM lineitem), t(role, word, status) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for (a, b), c in operational.pairs().items())}), o(word, outcome) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in operational.OUTCOMES.items())})
SELECT r.role, provider_status, status, CASE WHEN status IS NULL THEN 'unmapped_status' END AS status_error, CASE WHEN r.role = 'confirmation_events' THEN outcome END AS outcome, count(*) AS events
FROM r LEFT JOIN t ON t.role = r.role AND t.word = lower(trim(provider_status)) LEFT JOIN o ON o.word = lower(trim(provider_status)) GROUP BY ALL""")
def ops_provider_statuses(spark, sf_dir):
    """Providers' statuses of all six roles in canonical form; what no table has is told, not dropped."""
    r = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _REPORTED.items()])
    x = map_status(r, operational.pairs()).withColumn("outcome", F.when(F.col("role") == "confirmation_events", operational.outcome()))
    return x.groupBy("role", "provider_status", "status", "status_error", "outcome").agg(F.count(F.lit(1)).alias("events"))


_PAID = {
    "business_id": "concat('biz_', s_nationkey)", "remittance_id": "case when s_suppkey % 17 = 0 then ' ' else concat('r', s_suppkey) end", "period_start": "date '2024-01-01'", "period_end": "case when s_suppkey % 13 = 0 then date '2023-12-01' when s_suppkey % 29 = 0 then null else date '2024-01-31' end",
    "currency": "case when s_suppkey % 7 = 0 then 'usd' else 'USD' end", "gross_collected": "s_acctbal", "provider_fees": "case when s_suppkey % 11 = 0 then null else 1.0 end", "shipping_fees": "0.0", "cod_fees": "0.0", "net_remitted": "s_acctbal - 100", "adjustments": "-5.0",
    "settlement_status": "case when s_suppkey % 19 = 0 then 'lost' else 'remitted' end",
}
_PAID_CODES = [
    ("trim(remittance_id) = ''", "missing_identity"), ("period_end IS NULL OR period_end < period_start", "period_ends_before_start"), ("NOT regexp_matches(currency, '^[A-Z]{3}$')", "invalid_currency"), ("gross_collected < 0", "invalid_gross_collected"),
    ("provider_fees IS NULL", "invalid_provider_fees"), ("net_remitted < 0", "invalid_net_remitted"), ("settlement_status = 'lost'", "invalid_settlement_status"),
]


@query(f"""WITH r AS (SELECT s_suppkey, {', '.join(f'{e} AS {n}' for n, e in _PAID.items())} FROM supplier)
SELECT s_suppkey, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _PAID_CODES)}], lambda x: x IS NOT NULL), '|') AS codes FROM r""")
def ops_remittance_invariants(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", *[f"{e} as {n}" for n, e in _PAID.items()])
    return operational.checked(r, "remittance").select("s_suppkey", F.array_join("record_errors", "|").alias("codes"))
