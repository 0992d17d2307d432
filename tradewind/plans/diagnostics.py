"""Identity resolution between two systems, leakage, campaign diagnostics and ranked signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.core import hmac_sha256, phone, ratio, sample_band
from tradewind.operators import relational as R
from tradewind.operators.ordered import counted, pieces
from tradewind.plans.registry import query, table

#: Two noisy views of orders: what the shop saw, and the leads of the call centre.
_KEY = b"linkage"
_SHOP = {"shop_id": "o_orderkey", "phone_text": "concat('+212 6', lpad(cast(o_custkey as string), 8, '0'))", "at": "o_orderdate", "qty": "1 + o_orderkey % 3", "total": "o_totalprice", "country": "o_custkey % 5"}
_LEAD = {"lead_id": "o_orderkey + 7000000", "phone_text": "concat('06', lpad(cast(o_custkey as string), 8, '0'))", "at": "o_orderdate + make_dt_interval(0, cast(o_orderkey % 60 as int), 0, 0)", "qty": "1 + o_orderkey % 4", "total": "case when o_orderkey % 6 = 0 then o_totalprice + 1 else o_totalprice end", "country": "o_custkey % 4"}
_SIDES = """shop AS (SELECT o_orderkey AS shop_id, concat('2126', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS p, o_orderdate AS at, 1 + o_orderkey % 3 AS qty, o_totalprice AS total, o_custkey % 5 AS country FROM orders),
lead_rows AS (SELECT o_orderkey + 7000000 AS lead_id, concat('2126', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS p, o_orderdate + to_hours(CAST(o_orderkey % 60 AS INTEGER)) AS at, 1 + o_orderkey % 4 AS qty, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS total, o_custkey % 4 AS country FROM orders WHERE o_orderkey % 9 <> 4),
met AS (SELECT s.shop_id, l.lead_id, abs(epoch(l.at) - epoch(s.at)) / 3600 AS hours, CAST(round(0.55 + CASE WHEN s.qty = l.qty THEN 0.15 ELSE 0 END + CASE WHEN abs(s.total - l.total) <= 0.01 THEN 0.15 ELSE 0 END + CASE WHEN abs(epoch(l.at) - epoch(s.at)) <= 43200 THEN 0.10 ELSE 0.05 END + CASE WHEN s.country = l.country THEN 0.05 ELSE 0 END, 4) AS DOUBLE) AS score
 FROM shop s JOIN lead_rows l ON s.p = l.p AND abs(epoch(l.at) - epoch(s.at)) <= 172800),
ranked AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM met WINDOW w AS (PARTITION BY shop_id ORDER BY score DESC, hours, lead_id)),
best AS (SELECT *, count(*) FILTER (WHERE score >= 0.8 AND NOT coalesce(score - second < 0.05, false)) OVER (PARTITION BY lead_id) AS taken FROM ranked WHERE n = 1)"""


def resolve(shop: DataFrame, leads: DataFrame, hours: float = 48) -> DataFrame:
    """(shop_id, lead_id, score, outcome): equality on the keyed phone digest, then a time band and an additive score.

    Accepted from 0.80 on; ambiguous if the second best is closer than 0.05 or another order
    claims the lead; unmatched without a candidate that scores. The join's key has the phone and a
    stretch of `hours`: a lead goes to its own and both neighbouring ones, so a phone that many
    share is cut by time and no pair is met twice. Null phones and times match nothing.
    """
    stretch = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (hours * 3600))
    s = shop.withColumn("stretch", stretch("at")).alias("s")
    le = leads.withColumn("stretch", F.explode(F.array(*[stretch("at") + k for k in (-1, 0, 1)]))).alias("l")
    gap = F.abs(F.unix_timestamp(F.col("l.at").cast("timestamp")) - F.unix_timestamp(F.col("s.at").cast("timestamp")))
    met = s.join(le, (F.col("s.link") == F.col("l.link")) & (F.col("s.stretch") == F.col("l.stretch")) & (gap <= hours * 3600))
    score = F.lit(0.55) + F.when(F.col("s.qty") == F.col("l.qty"), 0.15).otherwise(0.0) + F.when(F.abs(F.col("s.total") - F.col("l.total")) <= 0.01, 0.15).otherwise(0.0) + F.when(gap <= 43200, 0.10).otherwise(0.05) + F.when(F.col("s.country") == F.col("l.country"), 0.05).otherwise(0.0)
    scored = met.select("s.shop_id", "l.lead_id", gap.alias("gap"), F.round(score, 4).alias("score"))
    w = Window.partitionBy("shop_id").orderBy(F.desc("score"), "gap", "lead_id")
    best = scored.withColumn("second", F.lead("score").over(w)).withColumn("n", F.row_number().over(w)).filter("n = 1")
    clear = (F.col("score") >= 0.8) & ~F.coalesce(F.round(F.col("score") - F.col("second"), 4) < 0.05, F.lit(False))
    best = best.withColumn("clear", clear).withColumn("taken", F.count_if("clear").over(Window.partitionBy("lead_id")))
    outcome = F.when(F.col("shop_id").isNull() | F.col("score").isNull() | (F.col("score") < 0.8), "UNMATCHED").when(~F.col("clear") | (F.col("taken") > 1), "AMBIGUOUS").otherwise("MATCHED")
    return shop.select("shop_id").join(best, "shop_id", "left").select("shop_id", "lead_id", "score", outcome.alias("outcome"))


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    link = hmac_sha256(_KEY, phone("phone_text"))
    shop = o.selectExpr(*[f"{e} as {n}" for n, e in _SHOP.items()]).withColumn("link", link)
    leads = o.filter("o_orderkey % 9 <> 4").selectExpr(*[f"{e} as {n}" for n, e in _LEAD.items()]).withColumn("link", link)
    return shop, leads


@query(f"""WITH {_SIDES.replace('score - second < 0.05', 'round(score - second, 4) < 0.05')} SELECT s.shop_id, b.lead_id, b.score, CASE WHEN score IS NULL OR score < 0.8 THEN 'UNMATCHED' WHEN coalesce(round(score - second, 4) < 0.05, false) OR taken > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS outcome
FROM shop s LEFT JOIN best b USING (shop_id)""")
def id_resolution(spark, sf_dir):
    return resolve(*sides(spark, sf_dir))


_CAMP = """camp AS (SELECT l_suppkey AS campaign, l_suppkey % 3 AS business, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS spend, count(*) AS platform, count(*) FILTER (WHERE l_quantity > 10) AS orders, count(*) FILTER (WHERE l_quantity > 20) AS matched, count(*) FILTER (WHERE l_quantity > 25) AS confirmed,
 count(*) FILTER (WHERE l_quantity > 30) AS shipped, count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag <> 'R') AS delivered, count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_linestatus = 'F') AS returned FROM lineitem GROUP BY 1, 2)"""


def campaigns(spark, sf_dir) -> DataFrame:
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    back = F.col("l_returnflag") == "R"
    return li.groupBy(F.col("l_suppkey").alias("campaign"), (F.col("l_suppkey") % 3).alias("business")).agg(
        F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")).cast("double").alias("spend"), F.count(F.lit(1)).alias("platform"), F.count_if(q > 10).alias("orders"), F.count_if(q > 20).alias("matched"), F.count_if(q > 25).alias("confirmed"),
        F.count_if(q > 30).alias("shipped"), F.count_if((q > 30) & ~back).alias("delivered"), F.count_if((q > 30) & back & (F.col("l_linestatus") == "F")).alias("returned"))


_STAGES = [("PLATFORM_VS_OBSERVED", 1, "greatest(platform - orders, 0)", "platform"), ("IDENTITY_UNRESOLVED", 2, "orders - matched", "orders"), ("MATCHED_NOT_CONFIRMED", 3, "greatest(matched - confirmed, 0)", "matched"), ("CONFIRMED_NOT_SHIPPED", 4, "greatest(confirmed - shipped, 0)", "confirmed"), ("RETURNED_AFTER_SHIPMENT", 5, "returned", "shipped"), ("SHIPPED_TERMINAL_UNRESOLVED", 6, "greatest(shipped - delivered - returned, 0)", "shipped")]
_TOTALS = ["platform", "orders", "matched", "confirmed", "shipped", "delivered", "returned"]
_LEAK_SQL = f"t AS (SELECT business, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _TOTALS)} FROM camp GROUP BY 1), leak AS ({' UNION ALL '.join(f'''SELECT business, '{s}' AS stage, {n} AS stage_order, {o} AS observed, {d} AS denominator, ({o}) / nullif({d}, 0) AS rate FROM t''' for s, n, o, d in _STAGES)})"


def leakage(c: DataFrame) -> DataFrame:
    t = c.groupBy("business").agg(*[F.sum(x).cast("long").alias(x) for x in _TOTALS])
    rows = [(s, n, F.expr(o), F.expr(d)) for s, n, o, d in _STAGES]
    return R.unpivot(t, ["business"], rows, ["stage", "stage_order", "observed", "denominator"]).withColumn("rate", ratio("observed", "denominator"))


@query(f"WITH {_CAMP}, {_LEAK_SQL} SELECT * FROM leak")
def dx_leakage(spark, sf_dir):
    return leakage(campaigns(spark, sf_dir))


_DIAG_SQL = """peers AS (SELECT *, sum(shipped) OVER b - shipped AS p_shipped, sum(delivered) OVER b - delivered AS p_delivered, sum(returned) OVER b - returned AS p_returned FROM camp WINDOW b AS (PARTITION BY business)),
diag AS (SELECT campaign, business, shipped, delivered, returned, delivered / nullif(shipped, 0) AS delivery_rate, p_delivered / nullif(p_shipped, 0) AS peer_delivery_rate, returned / nullif(shipped, 0) AS return_rate, p_returned / nullif(p_shipped, 0) AS peer_return_rate, spend / nullif(delivered, 0) AS cost,
 CASE WHEN shipped < 30 THEN 'LOW' WHEN shipped < 100 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM peers)"""


def diagnose(c: DataFrame) -> DataFrame:
    """Each campaign beside the others of its business, as totals less its own."""
    p = R.others(c, ["business"], {f"p_{x}": x for x in ("shipped", "delivered", "returned")})
    return p.select("campaign", "business", "shipped", "delivered", "returned", ratio("delivered", "shipped").alias("delivery_rate"), ratio("p_delivered", "p_shipped").alias("peer_delivery_rate"), ratio("returned", "shipped").alias("return_rate"), ratio("p_returned", "p_shipped").alias("peer_return_rate"), ratio("spend", "delivered").alias("cost"), sample_band(F.col("shipped")).alias("band"))


@query(f"WITH {_CAMP}, {_DIAG_SQL} SELECT * FROM diag")
def dx_campaigns(spark, sf_dir):
    return diagnose(campaigns(spark, sf_dir))


_SIGNAL_SQL = """sig AS (SELECT 'DELIVERY_GAP' AS signal, CAST(campaign AS VARCHAR) AS subject, band, peer_delivery_rate - delivery_rate AS gap, (peer_delivery_rate - delivery_rate) * shipped AS impact FROM diag WHERE band <> 'LOW' AND peer_delivery_rate - delivery_rate >= 0.02
UNION ALL SELECT 'RETURN_GAP', CAST(campaign AS VARCHAR), band, return_rate - peer_return_rate, (return_rate - peer_return_rate) * shipped FROM diag WHERE band <> 'LOW' AND return_rate - peer_return_rate >= 0.02
UNION ALL SELECT 'LEAKAGE', concat(business, ':', stage), 'HIGH', rate, CAST(observed AS DOUBLE) FROM leak WHERE observed > 0),
pri AS (SELECT *, CASE WHEN subject LIKE '%PLATFORM%' THEN 'LOW' WHEN band = 'LOW' THEN 'LOW' WHEN impact >= 100 THEN 'HIGH' WHEN impact >= 25 OR gap >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM sig)"""


@query(f"WITH {_CAMP}, {_LEAK_SQL}, {_DIAG_SQL}, {_SIGNAL_SQL} SELECT signal, subject, band, round(gap, 6) AS gap, round(impact, 4) AS impact, priority, row_number() OVER (ORDER BY CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, round(impact, 4) DESC NULLS LAST, signal, subject) AS rank FROM pri")
def dx_signals(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    d = diagnose(c)
    gap = lambda name, g: d.filter((F.col("band") != "LOW") & (g >= 0.02)).select(F.lit(name).alias("signal"), F.col("campaign").cast("string").alias("subject"), "band", g.alias("gap"), (g * F.col("shipped")).alias("impact"))
    leak = leakage(c).filter("observed > 0").select(F.lit("LEAKAGE").alias("signal"), F.concat("business", F.lit(":"), "stage").alias("subject"), F.lit("HIGH").alias("band"), F.col("rate").alias("gap"), F.col("observed").cast("double").alias("impact"))
    s = gap("DELIVERY_GAP", F.col("peer_delivery_rate") - F.col("delivery_rate")).unionByName(gap("RETURN_GAP", F.col("return_rate") - F.col("peer_return_rate"))).unionByName(leak)
    pri = F.when(F.col("subject").contains("PLATFORM") | (F.col("band") == "LOW"), "LOW").when(F.col("impact") >= 100, "HIGH").when((F.col("impact") >= 25) | (F.col("gap") >= 0.2), "MEDIUM").otherwise("LOW")
    s = s.withColumn("priority", pri).withColumn("gap", F.round("gap", 6)).withColumn("impact", F.round("impact", 4))
    tier = F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    s = s.withColumns({"tier": tier, "unknown": F.col("impact").isNull(), "down": -F.col("impact")})
    order = ["tier", "unknown", "down", "signal", "subject"]
    # numbered in ranges: signals grow with the campaigns
    return counted(pieces(s, [], order, "signals"), [], order, F.lit(1), "rank").withColumn("rank", (F.col("rank") + 1).cast("int")).drop("piece", "tier", "unknown", "down")
