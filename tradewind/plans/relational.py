"""One query for each relational operator: joins, windows, top-k, sets, conditional and ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions.core import money, ratio, sample_band
from tradewind.operators import relational as R
from tradewind.plans.registry import query, table
from tradewind.sources import commerce

_SPEND = "spend AS (SELECT l_suppkey AS campaign, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS spend FROM lineitem GROUP BY 1)"
_OUT = "outcomes AS (SELECT l_suppkey AS campaign, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1)"


def _spend(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("campaign")).agg(money(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"))


@query(f"WITH {_SPEND}, {_OUT} SELECT s.campaign, spend, coalesce(returned, 0) AS returned, o.campaign IS NOT NULL AS has_outcomes, spend / nullif(returned, 0) AS cost_per_return FROM spend s LEFT JOIN outcomes o USING (campaign)")
def op_left_outcomes(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_suppkey").alias("campaign")).agg(F.count(F.lit(1)).alias("returned"), F.lit(True).alias("there"))
    joined = _spend(spark, sf_dir).join(out, "campaign", "left").withColumn("cost_per_return", ratio("spend", "returned"))
    return joined.select("campaign", "spend", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("there", F.lit(False)).alias("has_outcomes"), "cost_per_return")


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS lines FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT coalesce(a.day, b.day) AS day, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM a FULL JOIN b ON a.day = b.day""")
def op_full_daily(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("lines"))
    return a.join(b, "day", "full").select("day", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def op_semi_targets(spark, sf_dir):
    target = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(target, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey AS orphan FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def op_anti_orphans(spark, sf_dir):
    return R.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))""")
def op_nested_anti(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    open_orders = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(open_orders, "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {_SPEND}, k AS (SELECT campaign, campaign % 3 AS business, spend FROM spend)
SELECT a.campaign, a.spend, CAST(sum(CAST(b.spend AS DECIMAL(18,4))) AS DOUBLE) AS others_spend FROM k a LEFT JOIN k b ON a.business = b.business AND a.campaign <> b.campaign GROUP BY a.campaign, a.spend""")
def op_leave_one_out(spark, sf_dir):
    k = _spend(spark, sf_dir).withColumn("business", F.col("campaign") % 3).withColumn("exact", F.col("spend").cast("decimal(18,4)"))
    met = R.with_totals(k, ["business"], {"n": F.count(F.lit(1)), "total": F.sum("exact")})
    return met.select("campaign", "spend", F.when(F.col("n") > 1, (F.col("total") - F.col("exact")).cast("double")).alias("others_spend"))


@query("""WITH t AS (SELECT o_orderpriority AS priority, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1)
SELECT priority, stage, stage_order, observed, orders, observed / nullif(orders, 0) AS rate FROM (SELECT priority, orders, 'FINISHED' AS stage, 1 AS stage_order, finished AS observed FROM t
UNION ALL SELECT priority, orders, 'PENDING', 2, pending FROM t UNION ALL SELECT priority, orders, 'OPEN', 3, greatest(orders - finished - pending, 0) FROM t)""")
def op_unpivot_stages(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    rows = [("FINISHED", 1, F.col("finished")), ("PENDING", 2, F.col("pending")), ("OPEN", 3, F.greatest(F.col("orders") - F.col("finished") - F.col("pending"), F.lit(0)))]
    return R.unpivot(t, ["priority", "orders"], rows, ["stage", "stage_order", "observed"]).withColumn("rate", ratio("observed", "orders"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def op_latest_per_key(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c.c_custkey, x.o_orderkey AS last_order, x.o_orderstatus AS last_status FROM customer c LEFT JOIN LATERAL
  (SELECT o_orderkey, o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true""")
def op_lateral_top1(spark, sf_dir):
    last = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.col("x.o_orderkey").alias("last_order"), F.col("x.o_orderstatus").alias("last_status"))


_RANGES = {"subject": "l_partkey", "id": "l_orderkey * 10 + l_linenumber", "valid_from": "cast(l_shipdate as date)", "days": "cast(l_quantity as int)"}


@query("""WITH r AS (SELECT l_partkey AS subject, l_orderkey * 10 + l_linenumber AS id, min(CAST(l_shipdate AS DATE)) AS valid_from, max(CAST(l_quantity AS INT)) AS days FROM lineitem WHERE l_tax >= 0.06 GROUP BY 1, 2)
SELECT a.subject, a.id AS left_id, b.id AS right_id FROM r a JOIN r b ON a.subject = b.subject AND a.id < b.id AND a.valid_from <= b.valid_from + b.days AND b.valid_from <= a.valid_from + a.days""")
def op_overlap_self_join(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_tax >= 0.06").selectExpr(*[f"{e} as {c}" for c, e in _RANGES.items()]).groupBy("subject", "id").agg(F.min("valid_from").alias("valid_from"), F.max("days").alias("days"))
    return R.overlapping(r.withColumn("valid_to", F.date_add("valid_from", F.col("days"))), ["subject"], "id")


@query("""WITH r AS (SELECT l_partkey % 40 AS subject, l_suppkey AS record, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) % 3 AS b FROM lineitem),
s AS (SELECT *, max(b) OVER (PARTITION BY subject, record ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject, record ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM s),
w AS (SELECT subject, record, min(a) AS a, max(b) AS b FROM g GROUP BY subject, record, n),
m AS (SELECT *, max({'b': b, 'r': record}) OVER (PARTITION BY subject ORDER BY a, record, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM w)
SELECT subject, record, a AS valid_from, b AS valid_to, last.r AS other FROM m WHERE last.b >= a""")
def op_overlap_conflicts(spark, sf_dir):
    """Conflicts of few subjects with very many intervals, without their pairs."""
    day = F.to_date("l_shipdate")
    r = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("subject"), F.col("l_suppkey").alias("record"), day.alias("valid_from"), F.date_add(day, F.col("l_quantity").cast("int") % 3).alias("valid_to"))
    return R.conflicts(r, ["subject"], "record")


@query("SELECT n_name, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS best_building, bool_or(c_acctbal > 9900) AS any_rich FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def op_filter_aggs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("best_building"), F.bool_or(F.col("c_acctbal") > 9900).alias("any_rich"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def op_having_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def op_duplicate_excess(spark, sf_dir):
    return R.duplicate_excess(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def op_topk_per_group(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49")
def op_set_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter("l_returnflag = 'A' and l_quantity > 30").select(F.col("l_suppkey").alias("k")).subtract(li.filter("l_returnflag = 'R' and l_quantity > 49").select("l_suppkey"))


@query("SELECT event_type, avg(CAST(value AS DECIMAL(18,4))) AS mean_value, median(value) AS median_value, quantile_cont(value, 0.95) AS p95_value FROM events GROUP BY 1")
def op_percentiles(spark, sf_dir):
    # avg of decimals is exact in Spark; as double on both sides
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("mean_value"), F.median("value").alias("median_value"), F.percentile("value", F.lit(0.95)).alias("p95_value"))


@query("""SELECT 'orders' AS series, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'events', CAST(ts AS DATE), CAST(count(*) AS DOUBLE) FROM events GROUP BY 2
UNION ALL SELECT 'shipped_lines', CAST(l_shipdate AS DATE), CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 2""")
def op_union_series(spark, sf_dir):
    parts = [("orders", "orders", "o_orderdate"), ("events", "events", "ts"), ("shipped_lines", "lineitem", "l_shipdate")]
    frames = [table(spark, sf_dir, t).groupBy(F.to_date(c).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(s).alias("series"), "day", "value") for s, t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""")
def op_semantic_order_topk(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT c_mktsegment, n, CASE WHEN n < 30 THEN 'LOW' WHEN n < 100 THEN 'MEDIUM' ELSE 'HIGH' END AS band, CASE WHEN lo = hi THEN lo ELSE 'MIXED_OR_UNKNOWN' END AS nation
FROM (SELECT c_mktsegment || '/' || c_nationkey AS c_mktsegment, count(*) AS n, min(n_name) AS lo, max(n_name) AS hi FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)""")
def op_sample_bands(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"), R.single_or("n_name", F.lit("MIXED_OR_UNKNOWN")).alias("nation"))
    return g.withColumn("band", sample_band(F.col("n")))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN n = total_n THEN 100 - (cum - part) ELSE part END AS share FROM (
SELECT *, CAST(sum(part) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS cum FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS total_n, 100 // count(*) OVER (PARTITION BY o_custkey) AS part FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)))""")
def op_remainder_allocation(spark, sf_dir):
    w, all_rows = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(all_rows).alias("total_n")).withColumn("part", F.expr("100 div total_n"))
    x = x.withColumn("cum", F.sum("part").over(w))
    return x.select("o_custkey", "o_orderkey", F.when(F.col("n") == F.col("total_n"), 100 - (F.col("cum") - F.col("part"))).otherwise(F.col("part")).alias("share"))


@query(f"WITH {commerce.ORDERS_SQL} SELECT order_id, currency, time_zone, CAST(timezone(time_zone, timezone('UTC', created_at)) AS DATE) AS business_day FROM orders_in")
def op_zone_days(spark, sf_dir):
    o = commerce.orders(spark, sf_dir)
    return o.select("order_id", "currency", "time_zone", F.to_date(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), F.col("time_zone"))).alias("business_day"))
