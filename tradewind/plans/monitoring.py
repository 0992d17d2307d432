"""Monitoring views over quality runs, and the alert lifecycle; orders stand for runs, events for occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import alerts as A
from tradewind.operators.relational import latest
from tradewind.plans.registry import query, table

_RUNS = {"run_id": "o_orderkey", "dataset": "o_orderpriority", "started_at": "o_orderdate", "status": "case o_orderstatus when 'F' then 'PASS' when 'O' then 'WARN' else 'FAIL' end", "severity": "case when o_totalprice > 300000 then 'CRITICAL' else 'WARNING' end"}
_RUNS_SQL = f"runs AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RUNS.items())} FROM orders)"
_EXPECTED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER RUN"]


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _RUNS.items()])


_LATEST = "latest AS (SELECT DISTINCT ON (dataset) * FROM runs ORDER BY dataset, started_at DESC, run_id DESC)"


@query(f"WITH {_RUNS_SQL}, {_LATEST} SELECT dataset, run_id, started_at, status FROM latest")
def mon_latest_status(spark, sf_dir):
    return latest(runs(spark, sf_dir), ["dataset"], [F.desc("started_at"), F.desc("run_id")]).select("dataset", "run_id", "started_at", "status")


@query(f"WITH {_RUNS_SQL} SELECT dataset, CAST(started_at AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') AS critical, max(started_at) FILTER (WHERE status = 'FAIL') AS last_failure FROM runs GROUP BY 1, 2")
def mon_failure_summary(spark, sf_dir):
    bad = F.col("status") == "FAIL"
    return runs(spark, sf_dir).groupBy("dataset", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("severity") == "CRITICAL")).alias("critical"), F.max(F.when(bad, F.col("started_at"))).alias("last_failure"))


@query(f"""WITH {_RUNS_SQL}, {_LATEST}, expected(dataset) AS (VALUES {', '.join(f"('{x}')" for x in _EXPECTED)}), good AS (SELECT dataset, max(started_at) AS last_good FROM runs WHERE status = 'PASS' GROUP BY 1)
SELECT e.dataset, coalesce(l.status, 'UNKNOWN') AS status, l.started_at, last_good, CASE WHEN bool_or(l.status = 'FAIL') OVER () THEN 'FAIL' WHEN bool_or(l.status IS NULL) OVER () THEN 'UNKNOWN' WHEN bool_or(l.status = 'WARN') OVER () THEN 'WARN' ELSE 'PASS' END AS overall
FROM expected e LEFT JOIN latest l USING (dataset) LEFT JOIN good g USING (dataset)""")
def mon_health(spark, sf_dir):
    r = runs(spark, sf_dir)
    # one pass: the last run and the last good run of each dataset
    g = r.groupBy("dataset").agg(F.max(F.struct("started_at", "run_id", "status")).alias("x"), F.max(F.when(F.col("status") == "PASS", F.col("started_at"))).alias("last_good"))
    x = spark.createDataFrame([(d,) for d in _EXPECTED], "dataset string").join(g, "dataset", "left").select("dataset", F.coalesce("x.status", F.lit("UNKNOWN")).alias("status"), F.col("x.started_at").alias("started_at"), "last_good")
    worst = x.agg(F.max(F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "UNKNOWN", 2).when(F.col("status") == "WARN", 1).otherwise(0)).alias("w"))
    return x.crossJoin(worst).select("dataset", "status", "started_at", "last_good", F.element_at(F.array(*map(F.lit, ["PASS", "WARN", "UNKNOWN", "FAIL"])), F.col("w") + 1).alias("overall"))


_OCC = {"alert": "concat(event_type, '/', user_id % 40)", "occurrence_id": "event_id", "seen_at": "cast(ts as date)", "severity": "case when value > 80 then 'CRITICAL' when value > 40 then 'WARNING' else 'INFO' end", "evidence": "value"}
_OCC_SQL = f"""occ AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _OCC.items())} FROM events), marked AS (SELECT *, coalesce(seen_at - lag(seen_at) OVER (PARTITION BY alert ORDER BY seen_at, occurrence_id) > 2, false)::INT AS n FROM occ),
numbered AS (SELECT *, CAST(sum(n) OVER (PARTITION BY alert ORDER BY seen_at, occurrence_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident FROM marked),
incidents AS (SELECT alert, incident, count(DISTINCT occurrence_id) AS occurrences, max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS severity_rank, min(seen_at) AS first_seen, max(seen_at) AS last_seen, arg_max(evidence, {{'a': seen_at, 'b': occurrence_id}}) AS evidence FROM numbered GROUP BY 1, 2)"""


def occurrences(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in _OCC.items()])


def incidents(spark, sf_dir):
    return A.fold(occurrences(spark, sf_dir), "alert", 2)


@query(f"WITH {_OCC_SQL} SELECT * FROM incidents")
def al_incident_fold(spark, sf_dir):
    return incidents(spark, sf_dir)


_TRIES_SQL = "tries AS (SELECT alert, incident, CASE occurrence_id % 3 WHEN 0 THEN 'INITIAL' WHEN 1 THEN 'RECURRENCE' ELSE 'ESCALATION' END AS kind, count(*) AS tries, bool_or(evidence > 90) AS done FROM numbered WHERE occurrence_id % 7 < 3 GROUP BY 1, 2, 3)"


@query(f"""WITH {_OCC_SQL}, {_TRIES_SQL}, wanted AS (SELECT alert, incident, 'INITIAL' AS kind FROM incidents UNION ALL SELECT alert, incident, 'RECURRENCE' FROM incidents WHERE occurrences >= 3
 UNION ALL SELECT alert, incident, 'ESCALATION' FROM incidents WHERE DATE '2024-01-31' - first_seen >= 14)
SELECT w.alert, w.incident, w.kind, coalesce(tries, 0) AS tries FROM wanted w LEFT JOIN tries t ON w.alert = t.alert AND w.incident = t.incident AND w.kind = t.kind WHERE NOT coalesce(done, false) AND coalesce(tries, 0) < 3""")
def al_due_deliveries(spark, sf_dir):
    i = incidents(spark, sf_dir)
    tries = A.numbered(occurrences(spark, sf_dir), "alert", 2).filter("occurrence_id % 7 < 3").select("alert", "incident", F.expr("case occurrence_id % 3 when 0 then 'INITIAL' when 1 then 'RECURRENCE' else 'ESCALATION' end as kind"), (F.col("evidence") > 90).alias("ok"))
    return A.due(i, tries, ["alert", "incident"], "2024-01-31", 3, 14, 3)


@query(f"""WITH {_RUNS_SQL} SELECT dataset, count(*) AS eligible FROM runs r WHERE started_at < TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.run_id AND l.l_shipdate >= TIMESTAMP '1999-01-01'
 AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0)) GROUP BY 1""")
def al_retention(spark, sf_dir):
    settled = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    alive = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz '1999-01-01 00:00:00'").join(settled, "l_suppkey", "left_anti").select(F.col("l_orderkey").alias("run_id"))
    return runs(spark, sf_dir).filter("started_at < timestamp_ntz '1999-01-01 00:00:00'").join(alive, "run_id", "left_anti").groupBy("dataset").agg(F.count(F.lit(1)).alias("eligible"))


_COMMANDS = {
    "alert_id": "l_orderkey",
    "target": "case l_returnflag when 'A' then 'ACKNOWLEDGED' when 'R' then 'RESOLVED' else 'OPEN' end",
    "at": "l_shipdate",
    "number": "l_linenumber * 1000000 + l_partkey",
    "by": "case when l_suppkey % 10 = 0 then ' ' else concat('op_', l_suppkey) end",
}


@query(f"""WITH commands AS (SELECT {', '.join(f'{e} AS "{n}"' for n, e in _COMMANDS.items())} FROM lineitem),
named AS (SELECT * FROM commands WHERE target <> 'OPEN' AND trim("by") <> ''),
f AS (SELECT alert_id, min({{'at': "at", 'number': number, 'by': "by"}}) FILTER (WHERE target = 'ACKNOWLEDGED') AS a, min({{'at': "at", 'number': number, 'by': "by"}}) FILTER (WHERE target = 'RESOLVED') AS r FROM named GROUP BY 1),
k AS (SELECT alert_id, CASE WHEN r IS NULL OR a.at < r.at OR (a.at = r.at AND a.number < r.number) THEN a END AS a, r FROM f)
SELECT alert_id, 'OPEN' AS previous_status, 'ACKNOWLEDGED' AS new_status, a.at AS changed_at, a.by AS changed_by FROM k WHERE a IS NOT NULL
UNION ALL SELECT alert_id, CASE WHEN a IS NULL THEN 'OPEN' ELSE 'ACKNOWLEDGED' END, 'RESOLVED', r.at, r.by FROM k WHERE r IS NOT NULL""")
def al_transitions(spark, sf_dir):
    return A.audit(table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _COMMANDS.items()]))


_ATTEMPTS = {"key": "l_orderkey", "attempt": "l_linenumber", "status": "case l_returnflag when 'A' then 'SENT' when 'R' then 'FAILED' else 'PENDING' end", "completed_at": "l_shipdate + interval 1 hour"}


@query(f"""WITH attempts AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ATTEMPTS.items())} FROM lineitem), last AS (SELECT key, max({{'a': attempt, 'c': completed_at, 's': status}}) AS x FROM attempts GROUP BY 1)
SELECT o_orderkey AS key, coalesce(x.a, 0) + 1 AS attempt FROM orders LEFT JOIN last ON key = o_orderkey
WHERE coalesce(x.a, 0) + 1 <= 5 AND (x IS NULL OR (x.s = 'FAILED' AND x.c + INTERVAL 30 MINUTE <= TIMESTAMP '1998-01-01'))""")
def al_claims(spark, sf_dir):
    attempts = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ATTEMPTS.items()])
    return A.claims(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), attempts, "1998-01-01", 5, 30)


_LEGACY = {"incident_key": "concat(o_orderpriority, '/', o_custkey % 40)", "alert_id": "o_orderkey", "created_at": "o_orderdate", "severity": "case when o_totalprice > 400000 then 'CRITICAL' else 'INFO' end"}


@query(f"""WITH legacy AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _LEGACY.items())} FROM orders),
g AS (SELECT incident_key, min({{'c': created_at, 'i': alert_id, 's': severity}}) AS o, max(created_at) AS last_seen, count(*) AS occurrences, bool_or(severity = 'CRITICAL') AS worst FROM legacy GROUP BY 1)
SELECT incident_key, o.i AS alert_id, o.c AS first_seen, last_seen, occurrences, CASE WHEN worst THEN 'CRITICAL' WHEN occurrences > 1 THEN 'WARNING' ELSE o.s END AS severity, occurrences - 1 AS resolved FROM g""")
def al_migration(spark, sf_dir):
    return A.consolidated(table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _LEGACY.items()]))
