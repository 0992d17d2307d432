"""Report queries of the catalogue: templates over the marts, run with parameters."""

from __future__ import annotations

from tradewind.operators.templates import report
from tradewind.plans import economics, ledger, marketing, marketplace, monitoring, operations
from tradewind.plans.registry import query

ACTIVE = "SELECT alert, incident, occurrences, severity_rank, last_seen FROM incidents WHERE occurrences >= 2 [[AND severity_rank >= :severity]] [[AND alert = :alert]] [[AND last_seen >= :since]] ORDER BY severity_rank DESC, last_seen DESC, alert, incident LIMIT 50"


@query(f"WITH {monitoring._OCC_SQL} SELECT alert, incident, occurrences, severity_rank, last_seen FROM incidents WHERE occurrences >= 2 AND severity_rank >= 2 AND last_seen >= DATE '2024-01-15' ORDER BY severity_rank DESC, last_seen DESC, alert, incident LIMIT 50")
def bi_active_alerts(spark, sf_dir):
    return report(spark, ACTIVE, {"incidents": monitoring.incidents(spark, sf_dir)}, {"severity": "int", "since": "date"}, severity=2, since="2024-01-15")


@query(f"WITH {monitoring._RUNS_SQL} SELECT status, count(*) AS runs, min(started_at) AS first_run, max(started_at) AS last_run FROM runs WHERE dataset = '2-HIGH' GROUP BY status")
def bi_runs_by_status(spark, sf_dir):
    sql = "SELECT status, count(*) AS runs, min(started_at) AS first_run, max(started_at) AS last_run FROM runs WHERE 1 = 1 [[AND dataset = :dataset]] [[AND severity = :severity]] GROUP BY status"
    return report(spark, sql, {"runs": monitoring.runs(spark, sf_dir)}, dataset="2-HIGH")


@query(f"WITH {marketing._LATEST_SQL} SELECT report_date, currency, CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) / nullif(sum(clicks), 0) AS cpc FROM ad_days WHERE platform = 'tiktok' GROUP BY 1, 2")
def bi_spend_trend(spark, sf_dir):
    sql = "SELECT report_date, currency, cast(sum(cast(spend as decimal(18,4))) as double) AS spend, sum(clicks) AS clicks, cast(sum(cast(spend as decimal(18,4))) as double) / nullif(sum(clicks), 0) AS cpc FROM ad_days WHERE 1 = 1 [[AND platform = :platform]] [[AND campaign_id = :campaign]] GROUP BY report_date, currency"
    return report(spark, sql, {"ad_days": marketing.ad_days(spark, sf_dir)}, platform="tiktok")


@query(f"WITH {operations.CURRENT_SQL} SELECT business_id, status, count(*) AS orders FROM current WHERE status = 'SHIPPED' OR status = 'DELIVERED' GROUP BY 1, 2")
def bi_orders_by_status(spark, sf_dir):
    sql = "SELECT business_id, status, count(*) AS orders FROM order_state WHERE status IN ('SHIPPED', 'DELIVERED') [[AND business_id = :business]] GROUP BY business_id, status"
    return report(spark, sql, {"order_state": operations.current(spark, sf_dir)})


@query(f"WITH {economics._ORDERS_SQL} SELECT business_id, currency, count(*) AS orders, CAST(sum(CAST(net_remitted AS DECIMAL(28,8))) AS DOUBLE) AS net_remitted FROM eco WHERE economic_status = 'INCOMPLETE_COSTS' GROUP BY 1, 2")
def bi_incomplete_economics(spark, sf_dir):
    sql = "SELECT business_id, currency, count(*) AS orders, cast(sum(cast(net_remitted as decimal(28,8))) as double) AS net_remitted FROM eco WHERE 1 = 1 [[AND economic_status = :status]] GROUP BY business_id, currency"
    return report(spark, sql, {"eco": economics.orders(spark, sf_dir)}, status="INCOMPLETE_COSTS")


@query(f"WITH {ledger._LEDGER_SQL} SELECT date_trunc('month', day)::DATE AS month, count(DISTINCT invoice) AS invoices, CAST(sum(amount) AS DOUBLE) AS net FROM ledger WHERE sheet = 'second' GROUP BY 1")
def bi_ledger_months(spark, sf_dir):
    sql = "SELECT to_date(date_trunc('month', day)) AS month, count(DISTINCT invoice) AS invoices, cast(sum(amount) as double) AS net FROM ledger WHERE 1 = 1 [[AND sheet = :sheet]] [[AND class = :class]] GROUP BY 1"
    return report(spark, sql, {"ledger": ledger.ledger(spark, sf_dir)}, sheet="second")


@query(f"WITH {marketplace.CLASSIFIED_SQL}, {marketplace.DAILY_SQL} SELECT country, event_date, CAST(sum(orders) AS BIGINT) AS orders FROM daily WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2")
def bi_country_days(spark, sf_dir):
    sql = "SELECT country, event_date, sum(orders) AS orders FROM daily WHERE 1 = 1 [[AND event_date BETWEEN :first AND :last]] [[AND currency = :currency]] GROUP BY country, event_date"
    return report(spark, sql, {"daily": marketplace.daily_sales(marketplace.silver(spark, sf_dir))}, {"first": "date", "last": "date"}, first="2024-01-05", last="2024-01-20")
