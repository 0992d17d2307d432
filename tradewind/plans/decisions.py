"""Deterministic decision rules over diagnostics: opportunities, requirements, readiness and the order of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.plans import diagnostics as dx
from tradewind.plans.registry import query

#: Evidence that each kind of opportunity needs, and the task that brings it.
REQUIREMENTS = [
    ("DELIVERY", "delivery_rate", "review_couriers"), ("DELIVERY", "sample", "wait_for_sample"), ("DELIVERY", "cost", "load_costs"),
    ("RETURNS", "return_rate", "review_products"), ("RETURNS", "sample", "wait_for_sample"),
    ("COST", "cost", "load_costs"), ("COST", "spend", "load_spend"), ("COST", "sample", "wait_for_sample"),
]
_REQ_SQL = ", ".join(f"('{k}', '{r}', '{t}')" for k, r, t in REQUIREMENTS)
#: Least gaps that matter.
GAP, COST = 0.02, 1.05

_OPP_SQL = f"""med AS (SELECT business, median(cost) AS usual FROM diag GROUP BY 1), o AS (SELECT d.*, usual FROM diag d JOIN med USING (business)),
opp AS (SELECT campaign, 'DELIVERY' AS kind, round(peer_delivery_rate - delivery_rate, 6) AS gap, shipped, band, cost FROM o WHERE peer_delivery_rate - delivery_rate >= {GAP}
UNION ALL SELECT campaign, 'RETURNS', round(return_rate - peer_return_rate, 6), shipped, band, cost FROM o WHERE return_rate - peer_return_rate >= {GAP}
UNION ALL SELECT campaign, 'COST', round(cost / usual - 1, 6), shipped, band, cost FROM o WHERE cost >= {COST} * usual),
ranked AS (SELECT *, CASE WHEN band = 'LOW' THEN 'SUPPRESSED' WHEN gap * shipped >= 25 THEN 'HIGH' WHEN gap * shipped >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM opp)"""


def opportunities(d: DataFrame) -> DataFrame:
    """Gaps to peers that matter, with a priority; thin samples are suppressed, not dropped."""
    usual = d.groupBy("business").agg(F.median("cost").alias("usual"))
    o = d.join(usual, "business")
    kinds = [("DELIVERY", F.col("peer_delivery_rate") - F.col("delivery_rate"), GAP), ("RETURNS", F.col("return_rate") - F.col("peer_return_rate"), GAP)]
    parts = [o.filter(g >= least).select("campaign", F.lit(k).alias("kind"), F.round(g, 6).alias("gap"), "shipped", "band", "cost") for k, g, least in kinds]
    parts.append(o.filter(F.col("cost") >= COST * F.col("usual")).select("campaign", F.lit("COST").alias("kind"), F.round(F.col("cost") / F.col("usual") - 1, 6).alias("gap"), "shipped", "band", "cost"))
    weight = F.col("gap") * F.col("shipped")
    p = F.when(F.col("band") == "LOW", "SUPPRESSED").when(weight >= 25, "HIGH").when(weight >= 5, "MEDIUM").otherwise("LOW")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("priority", p)


@query(f"WITH {dx._CAMP}, {dx._DIAG_SQL}, {_OPP_SQL} SELECT campaign, kind, gap, shipped, priority FROM ranked")
def dx_opportunities(spark, sf_dir):
    return opportunities(dx.diagnose(dx.campaigns(spark, sf_dir))).select("campaign", "kind", "gap", "shipped", "priority")


_RESOLVED_SQL = f"""req(kind, requirement, task) AS (VALUES {_REQ_SQL}), resolved AS (SELECT r.campaign, r.kind, requirement, task, CASE WHEN requirement = 'sample' THEN CASE band WHEN 'HIGH' THEN 'AVAILABLE' WHEN 'MEDIUM' THEN 'PARTIAL' ELSE 'MISSING' END
 WHEN requirement = 'cost' AND r.cost IS NULL THEN 'MISSING' WHEN requirement = 'cost' AND r.campaign % 4 = 0 THEN 'BLOCKED' ELSE 'AVAILABLE' END AS state FROM ranked r JOIN req USING (kind))"""


def resolve(opps: DataFrame) -> DataFrame:
    """The state of each requirement of each opportunity; the table of requirements is a constant."""
    req = opps.sparkSession.createDataFrame(REQUIREMENTS, "kind string, requirement string, task string")
    r = F.col("requirement")
    sample = F.when(F.col("band") == "HIGH", "AVAILABLE").when(F.col("band") == "MEDIUM", "PARTIAL").otherwise("MISSING")
    state = F.when(r == "sample", sample).when((r == "cost") & F.col("cost").isNull(), "MISSING").when((r == "cost") & (F.col("campaign") % 4 == 0), "BLOCKED").otherwise("AVAILABLE")
    return opps.join(F.broadcast(req), "kind").withColumn("state", state)


@query(f"""WITH {dx._CAMP}, {dx._DIAG_SQL}, {_OPP_SQL}, {_RESOLVED_SQL} SELECT campaign, kind, count(*) AS requirements, count(*) FILTER (WHERE state = 'AVAILABLE') AS available,
 CASE WHEN bool_or(state = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(state = 'MISSING') THEN 'NOT_READY' WHEN bool_or(state = 'PARTIAL') THEN 'PARTIAL' ELSE 'READY' END AS readiness FROM resolved GROUP BY 1, 2""")
def dx_readiness(spark, sf_dir):
    r = resolve(opportunities(dx.diagnose(dx.campaigns(spark, sf_dir))))
    any_ = lambda s: F.bool_or(F.col("state") == s)
    ready = F.when(any_("BLOCKED"), "BLOCKED").when(any_("MISSING"), "NOT_READY").when(any_("PARTIAL"), "PARTIAL").otherwise("READY")
    return r.groupBy("campaign", "kind").agg(F.count(F.lit(1)).alias("requirements"), F.count_if(F.col("state") == "AVAILABLE").alias("available"), ready.alias("readiness"))


@query(f"""WITH {dx._CAMP}, {dx._DIAG_SQL}, {_OPP_SQL}, {_RESOLVED_SQL}, t AS (SELECT task, count(DISTINCT campaign || '/' || kind) AS unlocks, count(*) FILTER (WHERE state = 'BLOCKED') AS blocked, string_agg(DISTINCT requirement, ',' ORDER BY requirement) AS requirements FROM resolved WHERE state <> 'AVAILABLE' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY unlocks DESC, blocked, task) AS position FROM t""")
def dx_sequence(spark, sf_dir):
    """Tasks by how many opportunities they unlock; tasks are a constant few, so one ordered window is in place."""
    r = resolve(opportunities(dx.diagnose(dx.campaigns(spark, sf_dir)))).filter("state <> 'AVAILABLE'")
    t = r.groupBy("task").agg(F.count_distinct("campaign", "kind").alias("unlocks"), F.count_if(F.col("state") == "BLOCKED").alias("blocked"), F.array_join(F.array_sort(F.collect_set("requirement")), ",").alias("requirements"))
    return t.withColumn("position", F.row_number().over(Window.orderBy(F.desc("unlocks"), "blocked", "task")))
