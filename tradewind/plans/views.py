"""Monitoring views over quality runs, check results, anomalies, alerts and deliveries.

The driver's tables stand for the monitoring tables: orders for runs and alerts, lineitem for
check results and delivery attempts, events for evaluated points. Null measures stay null, an
alert that isn't resolved lasts until AS_OF, repeated rows are rows like any others, and empty
tables give empty views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.plans.registry import query, table

AS_OF = "2002-01-01"
_LAYER = "case {0} % 3 when 0 then 'silver' when 1 then 'gold' else 'analytics' end"

#: Each table: source, and its columns as expressions that Spark and DuckDB share.
TABLES = {
    "v_runs": ("orders", {
        "quality_run_id": "o_orderkey", "dataset_name": "o_orderpriority", "layer": _LAYER.format("o_custkey"), "attempt_number": "1 + o_orderkey % 2",
        "overall_status": "case o_orderstatus when 'F' then 'PASS' when 'O' then 'WARN' else 'FAIL' end", "started_at": "o_orderdate",
        "completed_at": "case o_orderkey % 3 when 0 then o_orderdate + interval 5 minute when 1 then o_orderdate + interval 26 hour else o_orderdate end",
    }),
    "v_results": ("lineitem", {
        "quality_run_id": "l_orderkey", "check_name": "concat('check_', l_linenumber)", "status": "case l_returnflag when 'R' then 'FAIL' when 'A' then 'WARN' else 'PASS' end",
        "severity": "case when l_tax > 0.05 then 'CRITICAL' else 'WARNING' end", "checked_at": "l_shipdate", "observed": "l_discount",
    }),
    "v_anomalies": ("events", {
        "anomaly_id": "event_id", "metric_name": "event_type", "dataset_name": "concat('dataset_', user_id % 4)", "layer": _LAYER.format("user_id"), "business_id": "concat('biz_', user_id % 3)",
        "status": "case when value > 90 then 'ANOMALY' when value < 10 then 'INSUFFICIENT_HISTORY' else 'NORMAL' end", "severity": "case when value > 96 then 'CRITICAL' else 'WARNING' end",
        "observed_at": "ts", "observed_value": "value", "expected_value": "case when event_id % 9 = 0 then null else value / 2 end",
        "baseline_strategy": "case event_id % 4 when 0 then 'day_of_week' when 1 then 'trend_adjusted' when 2 then 'seasonal_trend' else 'robust_history' end",
        "confidence": "case event_id % 5 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end", "fallback_used": "event_id % 3 = 0",
    }),
    "v_alerts": ("orders", {
        "alert_event_id": "o_orderkey", "source_type": "case when o_custkey % 2 = 0 then 'ANOMALY' else 'QUALITY_FAILURE' end", "dataset_name": "o_orderpriority", "layer": _LAYER.format("o_custkey"),
        "business_id": "concat('biz_', o_custkey % 3)", "severity": "case when o_totalprice > 300000 then 'CRITICAL' when o_totalprice > 100000 then 'WARNING' else 'INFO' end",
        "lifecycle_status": "case o_orderstatus when 'F' then 'RESOLVED' when 'O' then 'OPEN' else 'ACKNOWLEDGED' end", "occurrence_count": "1 + o_orderkey % 4",
        "first_seen_at": "o_orderdate", "last_seen_at": "o_orderdate + interval 3 day", "resolved_at": "case when o_orderstatus = 'F' then o_orderdate + interval 5 day else null end",
    }),
    "v_deliveries": ("lineitem", {
        "alert_event_id": "l_orderkey", "provider": "concat('provider_', l_suppkey % 3)", "destination_key": "concat('key_', l_partkey % 4)",
        "delivery_kind": "case l_linenumber % 3 when 0 then 'INITIAL' when 1 then 'RECURRENCE' else 'ESCALATION' end", "escalation_level": "l_linenumber % 4",
        "delivery_status": "case l_returnflag when 'A' then 'SENT' when 'R' then 'FAILED' else 'PENDING' end", "attempted_at": "l_shipdate", "completed_at": "case when l_returnflag = 'N' then null else l_shipdate + interval 1 hour end",
    }),
}


def frame(spark, sf_dir, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def _sql(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names)


def seconds(start: str | Column, stop: str | Column) -> Column:
    at = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return ((at(stop) - at(start)) / 1_000_000).cast("double")


def quality_history(runs: DataFrame) -> DataFrame:
    return runs.withColumn("completed_date", F.to_date("completed_at")).withColumn("duration_seconds", seconds("started_at", "completed_at"))


def check_history(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Each result with the context of its run; results without a run are none."""
    context = runs.select("quality_run_id", "dataset_name", "layer", "attempt_number", F.col("overall_status").alias("run_status"))
    return results.join(context, "quality_run_id").withColumn("checked_date", F.to_date("checked_at"))


def alert_history(alerts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    ended = F.coalesce(F.col("resolved_at"), F.lit(as_of).cast("timestamp_ntz"))
    days = {f"{c}_date": F.to_date(f"{c}_at") for c in ("first_seen", "last_seen", "resolved")}
    return alerts.withColumn("duration_seconds", seconds("first_seen_at", ended)).withColumns(days)


def deliveries(attempts: DataFrame, alerts: DataFrame) -> DataFrame:
    context = alerts.select("alert_event_id", "source_type", "dataset_name", "layer", "severity", "lifecycle_status", "occurrence_count", "business_id")
    return attempts.join(context, "alert_event_id").withColumn("attempted_date", F.to_date("attempted_at"))


def _history(spark, sf_dir):
    return check_history(frame(spark, sf_dir, "v_results"), frame(spark, sf_dir, "v_runs"))


def _deliveries(spark, sf_dir):
    return deliveries(frame(spark, sf_dir, "v_deliveries"), frame(spark, sf_dir, "v_alerts"))


_RUN_HISTORY = f"{_sql('v_runs')} SELECT *, CAST(completed_at AS DATE) AS completed_date, CAST(epoch(completed_at) - epoch(started_at) AS DOUBLE) AS duration_seconds FROM v_runs"
_CHECKS = f"""{_sql('v_runs', 'v_results')}, checks AS (SELECT q.*, r.dataset_name, r.layer, r.attempt_number, r.overall_status AS run_status, CAST(q.checked_at AS DATE) AS checked_date
FROM v_results q JOIN v_runs r ON q.quality_run_id = r.quality_run_id)"""
_ALERTS = f"""{_sql('v_alerts')}, history AS (SELECT *, CAST(epoch(coalesce(resolved_at, TIMESTAMP '{AS_OF}')) - epoch(first_seen_at) AS DOUBLE) AS duration_seconds,
 CAST(first_seen_at AS DATE) AS first_seen_date, CAST(last_seen_at AS DATE) AS last_seen_date, CAST(resolved_at AS DATE) AS resolved_date FROM v_alerts)"""
_SENT = f"""{_sql('v_deliveries', 'v_alerts')}, sent AS (SELECT d.*, a.source_type, a.dataset_name, a.layer, a.severity, a.lifecycle_status, a.occurrence_count, a.business_id, CAST(d.attempted_at AS DATE) AS attempted_date
FROM v_deliveries d JOIN v_alerts a ON d.alert_event_id = a.alert_event_id)"""


@query(_RUN_HISTORY)
def mon_quality_history(spark, sf_dir):
    return quality_history(frame(spark, sf_dir, "v_runs"))


@query(f"{_CHECKS} SELECT * FROM checks")
def mon_check_history(spark, sf_dir):
    return _history(spark, sf_dir)


@query(f"""{_CHECKS} SELECT dataset_name, layer, check_name, count(*) FILTER (WHERE status = 'FAIL') AS failure_count, count(*) FILTER (WHERE status = 'WARN') AS warning_count,
 count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') AS critical_failure_count, max(checked_at) FILTER (WHERE status = 'FAIL') AS latest_failure_at,
 max(checked_at) FILTER (WHERE status = 'WARN') AS latest_warning_at FROM checks GROUP BY ALL""")
def mon_check_failure_summary(spark, sf_dir):
    failed, warned = F.col("status") == "FAIL", F.col("status") == "WARN"
    return _history(spark, sf_dir).groupBy("dataset_name", "layer", "check_name").agg(
        F.count_if(failed).alias("failure_count"),
        F.count_if(warned).alias("warning_count"),
        F.count_if(failed & (F.col("severity") == "CRITICAL")).alias("critical_failure_count"),
        F.max(F.when(failed, F.col("checked_at"))).alias("latest_failure_at"),
        F.max(F.when(warned, F.col("checked_at"))).alias("latest_warning_at"),
    )


@query(f"{_CHECKS} SELECT * FROM checks WHERE status = 'FAIL' AND severity = 'CRITICAL'")
def mon_recent_critical_failures(spark, sf_dir):
    return _history(spark, sf_dir).filter("status = 'FAIL' and severity = 'CRITICAL'")


@query(f"{_sql('v_alerts')} SELECT * FROM v_alerts")
def mon_recent_alert_events(spark, sf_dir):
    return frame(spark, sf_dir, "v_alerts")


@query(f"{_sql('v_anomalies')} SELECT * FROM v_anomalies WHERE status = 'ANOMALY'")
def mon_recent_anomalies(spark, sf_dir):
    return frame(spark, sf_dir, "v_anomalies").filter("status = 'ANOMALY'")


@query(f"""{_sql('v_anomalies')} SELECT metric_name, dataset_name, layer, count(*) AS evaluations, count(*) FILTER (WHERE status = 'NORMAL') AS normal_count,
 count(*) FILTER (WHERE status = 'INSUFFICIENT_HISTORY') AS insufficient_history_count, count(*) FILTER (WHERE status = 'ANOMALY') AS anomaly_count,
 count(*) FILTER (WHERE status = 'ANOMALY' AND severity = 'CRITICAL') AS critical_anomaly_count, max(observed_at) FILTER (WHERE status = 'ANOMALY') AS latest_anomaly_at FROM v_anomalies GROUP BY 1, 2, 3""")
def mon_anomaly_summary_by_metric(spark, sf_dir):
    is_ = lambda s: F.col("status") == s
    return frame(spark, sf_dir, "v_anomalies").groupBy("metric_name", "dataset_name", "layer").agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if(is_("NORMAL")).alias("normal_count"),
        F.count_if(is_("INSUFFICIENT_HISTORY")).alias("insufficient_history_count"),
        F.count_if(is_("ANOMALY")).alias("anomaly_count"),
        F.count_if(is_("ANOMALY") & (F.col("severity") == "CRITICAL")).alias("critical_anomaly_count"),
        F.max(F.when(is_("ANOMALY"), F.col("observed_at"))).alias("latest_anomaly_at"),
    )


def by_day(anomalies: DataFrame, *keys: str) -> DataFrame:
    """Evaluations and anomalies by keys and day."""
    days = anomalies.withColumn("observed_date", F.to_date("observed_at"))
    return days.groupBy(*keys, "observed_date").agg(F.count(F.lit(1)).alias("evaluation_count"), F.count_if(F.col("status") == "ANOMALY").alias("anomaly_count"))


_DAY_KEYS = ["dataset_name", "layer", "severity", "status", "business_id"]


def _by_day_sql(*keys: str) -> str:
    return f"{_sql('v_anomalies')} SELECT {', '.join(keys)}, CAST(observed_at AS DATE) AS observed_date, count(*) AS evaluation_count, count(*) FILTER (WHERE status = 'ANOMALY') AS anomaly_count FROM v_anomalies GROUP BY ALL"


@query(_by_day_sql("baseline_strategy", *_DAY_KEYS))
def mon_anomalies_by_strategy(spark, sf_dir):
    return by_day(frame(spark, sf_dir, "v_anomalies"), "baseline_strategy", *_DAY_KEYS)


@query(_by_day_sql("confidence", "baseline_strategy", *_DAY_KEYS))
def mon_anomaly_confidence_summary(spark, sf_dir):
    return by_day(frame(spark, sf_dir, "v_anomalies"), "confidence", "baseline_strategy", *_DAY_KEYS)


@query(_by_day_sql("fallback_used", "baseline_strategy", *_DAY_KEYS))
def mon_baseline_fallback_summary(spark, sf_dir):
    return by_day(frame(spark, sf_dir, "v_anomalies"), "fallback_used", "baseline_strategy", *_DAY_KEYS)


@query(f"{_sql('v_alerts')} SELECT source_type, severity, lifecycle_status, count(*) AS alert_count, max(first_seen_at) AS latest_alert_at FROM v_alerts GROUP BY 1, 2, 3")
def mon_alert_summary_by_severity(spark, sf_dir):
    return frame(spark, sf_dir, "v_alerts").groupBy("source_type", "severity", "lifecycle_status").agg(F.count(F.lit(1)).alias("alert_count"), F.max("first_seen_at").alias("latest_alert_at"))


@query(f"""{_sql('v_alerts')} SELECT lifecycle_status, source_type, severity, dataset_name, layer, business_id, count(*) AS alert_count, CAST(sum(occurrence_count) AS BIGINT) AS occurrence_count,
 min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM v_alerts GROUP BY ALL""")
def mon_alert_summary_by_status(spark, sf_dir):
    keys = ["lifecycle_status", "source_type", "severity", "dataset_name", "layer", "business_id"]
    return frame(spark, sf_dir, "v_alerts").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alert_count"), F.sum("occurrence_count").cast("long").alias("occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


@query(f"{_ALERTS} SELECT * FROM history")
def mon_alert_history(spark, sf_dir):
    return alert_history(frame(spark, sf_dir, "v_alerts"))


@query(f"{_ALERTS} SELECT * FROM history WHERE lifecycle_status IN ('OPEN', 'ACKNOWLEDGED')")
def mon_active_alerts(spark, sf_dir):
    return alert_history(frame(spark, sf_dir, "v_alerts")).filter(F.col("lifecycle_status").isin("OPEN", "ACKNOWLEDGED"))


@query(f"{_ALERTS} SELECT * FROM history WHERE occurrence_count > 1")
def mon_recurring_alerts(spark, sf_dir):
    return alert_history(frame(spark, sf_dir, "v_alerts")).filter("occurrence_count > 1")


@query(f"{_SENT} SELECT * FROM sent")
def mon_recent_deliveries(spark, sf_dir):
    return _deliveries(spark, sf_dir)


@query(f"{_SENT} SELECT * FROM sent WHERE delivery_status = 'FAILED'")
def mon_failed_deliveries(spark, sf_dir):
    return _deliveries(spark, sf_dir).filter("delivery_status = 'FAILED'")


_PROVIDER = ["provider", "destination_key", "delivery_status", "delivery_kind", "dataset_name", "layer", "severity", "lifecycle_status", "attempted_date", "business_id"]


@query(f"{_SENT} SELECT {', '.join(_PROVIDER)}, count(*) AS delivery_attempts, max(attempted_at) AS latest_attempt_at FROM sent GROUP BY ALL")
def mon_delivery_summary_by_provider(spark, sf_dir):
    return _deliveries(spark, sf_dir).groupBy(*_PROVIDER).agg(F.count(F.lit(1)).alias("delivery_attempts"), F.max("attempted_at").alias("latest_attempt_at"))


@query(f"""{_SENT} SELECT alert_event_id, lifecycle_status, severity, dataset_name, layer, occurrence_count, provider, destination_key, business_id, max(escalation_level) AS escalation_level,
 max(completed_at) AS escalated_at, count(*) AS escalation_deliveries FROM sent WHERE lifecycle_status IN ('OPEN', 'ACKNOWLEDGED') AND delivery_kind = 'ESCALATION' AND delivery_status = 'SENT'
GROUP BY alert_event_id, lifecycle_status, severity, dataset_name, layer, occurrence_count, provider, destination_key, business_id""")
def mon_escalation_summary(spark, sf_dir):
    keys = ["alert_event_id", "lifecycle_status", "severity", "dataset_name", "layer", "occurrence_count", "provider", "destination_key", "business_id"]
    done = _deliveries(spark, sf_dir).filter("lifecycle_status in ('OPEN', 'ACKNOWLEDGED') and delivery_kind = 'ESCALATION' and delivery_status = 'SENT'")
    return done.groupBy(*keys).agg(F.max("escalation_level").alias("escalation_level"), F.max("completed_at").alias("escalated_at"), F.count(F.lit(1)).alias("escalation_deliveries"))
