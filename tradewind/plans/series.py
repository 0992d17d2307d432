"""Metric series from facts, their baselines, scores and walk-forward tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions.core import money, ratio
from tradewind.operators import anomaly as A
from tradewind.operators import metrics as M
from tradewind.plans.registry import query, table

_SQL = """points AS (SELECT o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value, count(*) AS n FROM orders GROUP BY 1, 2)"""


def points(spark, sf_dir):
    day = F.date_add(F.to_date(F.date_trunc("week", "o_orderdate")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), day.alias("day")).agg(money("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))


_HIST = f"""hist AS (SELECT *, coalesce(list(value) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN {A.WINDOW} PRECEDING AND 1 PRECEDING), []) AS h, coalesce(list(value) OVER (PARTITION BY series, isodow(day) ORDER BY day ROWS BETWEEN {A.WINDOW // 7 + 4} PRECEDING AND 1 PRECEDING), []) AS w FROM points),
used AS (SELECT *, CASE WHEN len(w) >= {A.LEAST_WEEKDAY} THEN 'day_of_week' WHEN len(h) >= {A.LEAST} THEN 'robust_history' END AS strategy, CASE WHEN len(w) >= {A.LEAST_WEEKDAY} THEN w WHEN len(h) >= {A.LEAST} THEN h END AS u, len(w) < {A.LEAST_WEEKDAY} AND len(h) >= {A.LEAST} AS fallback_used FROM hist),
based AS (SELECT *, list_median(u) AS baseline FROM used), spread AS (SELECT *, list_median(list_transform(u, lambda x: abs(x - baseline))) AS mad FROM based),
scored AS (SELECT *, CASE WHEN mad > 1e-12 THEN abs({A.Z} * (value - baseline) / mad) WHEN baseline <> 0 THEN abs((value - baseline) / baseline) ELSE abs(value - baseline) END AS score FROM spread),
graded AS (SELECT *, CASE WHEN baseline IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN score >= 6 THEN 'CRITICAL' WHEN score >= 3.5 THEN 'WARNING' ELSE 'NORMAL' END AS status,
 CASE WHEN baseline IS NULL THEN NULL WHEN NOT fallback_used AND len(u) >= 8 THEN 'HIGH' WHEN len(u) >= {2 * A.LEAST} THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM scored)"""


def graded(spark, sf_dir):
    return A.graded(A.robust(A.with_history(points(spark, sf_dir))))


@query(f"WITH {_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY series) - 1 AS history FROM points) SELECT series, day AS observed_at, value, history FROM r WHERE k = 1")
def an_series(spark, sf_dir):
    g = points(spark, sf_dir).groupBy("series").agg(F.max(F.struct("day", "value")).alias("x"), (F.count(F.lit(1)) - 1).alias("history"))
    return g.select("series", F.col("x.day").alias("observed_at"), F.col("x.value").alias("value"), "history")


@query(f"WITH {_SQL}, {_HIST} SELECT series, day, strategy, fallback_used, round(baseline, 4) AS baseline, round(mad, 4) AS mad FROM graded")
def an_robust(spark, sf_dir):
    return graded(spark, sf_dir).select("series", "day", "strategy", "fallback_used", F.round("baseline", 4).alias("baseline"), F.round("mad", 4).alias("mad"))


@query(f"WITH {_SQL}, {_HIST} SELECT series, day, value, status, confidence, round(score, 6) AS score FROM graded WHERE status IN ('WARNING', 'CRITICAL')")
def an_scored(spark, sf_dir):
    return graded(spark, sf_dir).filter("status in ('WARNING', 'CRITICAL')").select("series", "day", "value", "status", "confidence", F.round("score", 6).alias("score"))


@query(f"WITH {_SQL}, {_HIST} SELECT series, strategy, count(*) AS points, count(*) FILTER (WHERE status IN ('WARNING', 'CRITICAL')) AS alerts, count(*) FILTER (WHERE status IN ('WARNING', 'CRITICAL')) / count(*) AS alert_rate FROM graded WHERE baseline IS NOT NULL GROUP BY 1, 2")
def an_backtest(spark, sf_dir):
    g = graded(spark, sf_dir).filter("baseline is not null").groupBy("series", "strategy").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("status").isin("WARNING", "CRITICAL")).alias("alerts"))
    return g.withColumn("alert_rate", ratio("alerts", "points"))


@query(f"""WITH {_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k, CAST(day - DATE '1970-01-01' AS DOUBLE) AS x FROM points), h AS (SELECT * FROM r WHERE k BETWEEN 2 AND {A.WINDOW + 1}),
s AS (SELECT a.series, median((b.value - a.value) / nullif(b.x - a.x, 0)) AS slope FROM h a JOIN h b ON a.series = b.series AND a.x < b.x GROUP BY 1), l AS (SELECT h.series, slope, median(value - slope * x) AS level, count(*) AS n FROM h JOIN s ON h.series = s.series GROUP BY 1, 2)
SELECT r.series, day, value, round(slope, 4) AS slope, round(level + slope * x, 3) AS prediction FROM r JOIN l ON r.series = l.series WHERE k = 1 AND l.n >= {A.LEAST}""")
def an_trend(spark, sf_dir):
    return A.trend(points(spark, sf_dir)).select("series", "day", "value", F.round("slope", 4).alias("slope"), F.round("prediction", 3).alias("prediction"))


@query(f"WITH {_SQL}, p AS (SELECT *, n < 2 AS thin FROM points) SELECT series, count(*) FILTER (WHERE thin) AS thin_points, count(*) FILTER (WHERE NOT thin) AS kept_points, CAST(sum(CAST(value AS DECIMAL(28,4))) FILTER (WHERE NOT thin) AS DOUBLE) AS kept_value FROM p GROUP BY 1")
def an_sample_guard(spark, sf_dir):
    thin = F.col("n") < 2
    return points(spark, sf_dir).groupBy("series").agg(F.count_if(thin).alias("thin_points"), F.count_if(~thin).alias("kept_points"), F.sum(F.when(~thin, F.col("value").cast("decimal(28,4)"))).cast("double").alias("kept_value"))


@query(f"WITH {_SQL} SELECT series, day, value, value - lag(value) OVER w AS change, row_number() OVER w AS number FROM points WINDOW w AS (PARTITION BY series ORDER BY day)")
def an_changes(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("day")
    return points(spark, sf_dir).select("series", "day", "value", (F.col("value") - F.lag("value").over(w)).alias("change"), F.row_number().over(w).alias("number"))


def _chain_sql() -> str:
    line, flat = "list_transform({0}, lambda p: p.y - slope * p.x)", "list_transform({0}, lambda p: p.y)"
    return f"""{_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM points),
h AS (SELECT series, list({{'x': CAST(day - DATE '1970-01-01' AS DOUBLE), 'w': isodow(day), 'y': value}} ORDER BY day) AS h FROM r WHERE k BETWEEN 2 AND {A.LONGEST + 1} AND n >= 1 GROUP BY 1),
s AS (SELECT a.series, median((b.value - a.value) / nullif(date_diff('day', a.day, b.day), 0)) AS slope FROM r a JOIN r b ON a.series = b.series AND a.day < b.day WHERE a.k BETWEEN 2 AND {A.LONGEST + 1} AND b.k BETWEEN 2 AND {A.LONGEST + 1} GROUP BY 1),
m AS (SELECT r.series, r.day, r.value, CAST(r.day - DATE '1970-01-01' AS DOUBLE) AS x, h, slope, list_filter(h, lambda p: p.w = isodow(r.day)) AS same, h[greatest(len(h) - {A.WINDOW - 1}, 1):] AS tail FROM r JOIN h USING (series) LEFT JOIN s USING (series) WHERE k = 1),
c AS (SELECT *, CASE WHEN slope IS NOT NULL AND len(h) >= {A.LEAST_SEASONAL} AND len(same) >= {A.LEAST_WEEKDAY} THEN 'seasonal_trend' WHEN slope IS NOT NULL AND len(h) >= {A.LEAST_TREND} THEN 'trend' WHEN len(same) >= {A.LEAST_WEEKDAY} THEN 'day_of_week'
 WHEN len(tail) >= {A.LEAST} THEN 'robust_history' END AS strategy FROM m),
d AS (SELECT *, CASE strategy WHEN 'seasonal_trend' THEN {line.format('same')} WHEN 'trend' THEN {line.format('h')} WHEN 'day_of_week' THEN {flat.format('same')} WHEN 'robust_history' THEN {flat.format('tail')} END AS of FROM c),
e AS (SELECT *, list_median(of) + CASE WHEN strategy IN ('seasonal_trend', 'trend') THEN slope * x ELSE 0 END AS expected, list_transform(of, lambda v: v - list_median(of)) AS rest FROM d),
f AS (SELECT *, list_median(list_transform(rest, lambda v: abs(v - list_median(rest)))) AS mad FROM e),
g AS (SELECT *, CASE WHEN mad > 1e-12 THEN {A.WARNING[0]} * mad / {A.Z} WHEN expected <> 0 THEN abs(expected) * {A.WARNING[1]} ELSE {A.WARNING[2]} END AS near_, CASE WHEN mad > 1e-12 THEN {A.CRITICAL[0]} * mad / {A.Z} WHEN expected <> 0 THEN abs(expected) * {A.CRITICAL[1]} ELSE {A.CRITICAL[2]} END AS far_ FROM f)"""


@query(f"""WITH {_chain_sql()} SELECT series, day, strategy, strategy <> 'seasonal_trend' AS fallback_used, round(expected, 3) AS expected, round(mad, 3) AS mad, round(expected - near_, 2) AS lower, round(expected + near_, 2) AS upper,
CASE WHEN expected IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN abs(value - expected) >= near_ THEN 'ANOMALY' ELSE 'NORMAL' END AS status,
CASE WHEN expected IS NULL THEN 'INFO' WHEN abs(value - expected) >= far_ THEN 'CRITICAL' WHEN abs(value - expected) >= near_ THEN 'WARNING' ELSE 'INFO' END AS severity FROM g""")
def an_chain(spark, sf_dir):
    c = A.chain(points(spark, sf_dir), sample="n", least_sample=1)
    return c.select("series", "day", "strategy", "fallback_used", F.round("expected", 3).alias("expected"), F.round("mad", 3).alias("mad"), F.round("lower", 2).alias("lower"), F.round("upper", 2).alias("upper"), "status", "severity")


def _walk_sql(least: int) -> str:
    slopes = "list_median(list_filter(flatten(list_transform(range(1, len(h)), lambda i: list_transform(h[i + 1:], lambda b: (b.y - h[i].y) / nullif(b.x - h[i].x, 0)))), lambda v: v IS NOT NULL))"
    line, flat = "list_transform({0}, lambda p: p.y - slope * p.x)", "list_transform({0}, lambda p: p.y)"
    return f"""{_SQL}, q AS (SELECT *, n >= {least} AS enough, CAST(day - DATE '1970-01-01' AS DOUBLE) AS x, isodow(day) AS w FROM points),
o AS (SELECT *, coalesce(sum(enough::INT) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM q),
h AS (SELECT series, day, value, enough, x, list_sort(coalesce(list({{'x': x, 'w': w, 'y': value}}) FILTER (WHERE enough) OVER (PARTITION BY series ORDER BY c RANGE BETWEEN {A.LONGEST} PRECEDING AND 1 PRECEDING), [])) AS h FROM o),
m AS (SELECT *, {slopes} AS slope, list_filter(h, lambda p: p.w = isodow(day)) AS same, h[greatest(len(h) - {A.WINDOW - 1}, 1):] AS tail FROM h),
c AS (SELECT *, CASE WHEN NOT enough THEN NULL WHEN slope IS NOT NULL AND len(h) >= {A.LEAST_SEASONAL} AND len(same) >= {A.LEAST_WEEKDAY} THEN 'seasonal_trend' WHEN slope IS NOT NULL AND len(h) >= {A.LEAST_TREND} THEN 'trend' WHEN len(same) >= {A.LEAST_WEEKDAY} THEN 'day_of_week'
 WHEN len(tail) >= {A.LEAST} THEN 'robust_history' END AS strategy FROM m),
d AS (SELECT *, CASE strategy WHEN 'seasonal_trend' THEN {line.format('same')} WHEN 'trend' THEN {line.format('h')} WHEN 'day_of_week' THEN {flat.format('same')} WHEN 'robust_history' THEN {flat.format('tail')} END AS of FROM c),
e AS (SELECT *, list_median(of) + CASE WHEN strategy IN ('seasonal_trend', 'trend') THEN slope * x ELSE 0 END AS expected, list_transform(of, lambda v: v - list_median(of)) AS rest FROM d),
f AS (SELECT *, list_median(list_transform(rest, lambda v: abs(v - list_median(rest)))) AS mad FROM e),
g AS (SELECT *, CASE WHEN mad > 1e-12 THEN {A.WARNING[0]} * mad / {A.Z} WHEN expected <> 0 THEN abs(expected) * {A.WARNING[1]} ELSE {A.WARNING[2]} END AS near_ FROM f)"""


_TRUTH = "day(day) = 15"


@query(f"""WITH {_walk_sql(2)} SELECT series, coalesce(strategy, 'none') AS strategy, count(*) AS points, count(*) FILTER (WHERE abs(value - expected) >= near_) AS anomalies, count(*) FILTER (WHERE expected IS NULL) AS insufficient,
 count(*) FILTER (WHERE abs(value - expected) >= near_) / nullif(count(*) FILTER (WHERE expected IS NOT NULL), 0) AS alert_rate, count(*) FILTER (WHERE abs(value - expected) >= near_ AND NOT ({_TRUTH})) AS false_positive_proxy FROM g GROUP BY 1, 2""")
def an_walk_forward(spark, sf_dir):
    """The whole chain at every point, by the strategy that it took; middays of a month are labelled as true."""
    g = A.walk(points(spark, sf_dir), sample="n", least_sample=2)
    hit = F.col("status") == "ANOMALY"
    out = g.groupBy("series", F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(F.count(F.lit(1)).alias("points"), F.count_if(hit).alias("anomalies"), F.count_if(F.col("status") == "INSUFFICIENT_HISTORY").alias("insufficient"), F.count_if(hit & ~F.expr(_TRUTH)).alias("false_positive_proxy"))
    return out.withColumn("alert_rate", ratio(F.col("anomalies"), F.col("points") - F.col("insufficient")))


def _dims_sql(**columns: str) -> str:
    return " || ".join(["'{'", *[f"'{',' if i else ''}\"{n}\":\"' || {c} || '\"'" for i, (n, c) in enumerate(sorted(columns.items()))], "'}'"])


_SALES_SQL = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1, 2"
_LINES_SQL = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_returnflag AS flag, l_linestatus AS line, count(*) AS lines, count(*) FILTER (WHERE l_discount > 0.05) AS cut, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS units FROM lineitem GROUP BY 1, 2, 3"
_FUNNEL_SQL = "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY 1"


def _long_sql(dataset: str, dims: str, metrics: dict[str, tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{dataset}' AS dataset, '{m}' AS metric, {dims} AS dimensions, day, CAST({v} AS DOUBLE) AS value, CAST({n} AS BIGINT) AS sample FROM {source} WHERE ({v}) IS NOT NULL" for m, (v, n) in metrics.items())


_SALES = {"completed_order_volume": ("orders", "NULL"), "gross_revenue": ("revenue", "NULL"), "urgent_rate": ("urgent / nullif(orders, 0)", "orders")}
_LINES = {"units": ("units", "NULL"), "discount_rate": ("cut / nullif(lines, 0)", "lines")}
_FUNNEL = {"click_rate": ("clicks / nullif(views, 0)", "views"), "purchase_rate": ("purchases / nullif(clicks, 0)", "clicks"), "volume": ("n", "NULL")}
_METRICS_SQL = f"""sales AS ({_SALES_SQL}), shipped AS ({_LINES_SQL}), funnel AS ({_FUNNEL_SQL}),
long AS ({_long_sql("daily_sales", _dims_sql(status="status"), _SALES, "sales")} UNION ALL {_long_sql("shipping", _dims_sql(flag="flag", line="line"), _LINES, "shipped")} UNION ALL {_long_sql("funnel", "'{}'", _FUNNEL, "funnel")})"""


def metrics(spark, sf_dir):
    """Long metric rows of three fact tables, each aggregated and read once."""
    share = lambda a, b: ratio(a, b)
    o = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("revenue"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_discount") > 0.05).alias("cut"), money("l_quantity").alias("units"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"), F.count(F.lit(1)).alias("n"))
    return (
        M.extract(o, "daily_sales", "day", ["status"], {"completed_order_volume": (F.col("orders"), None), "gross_revenue": (F.col("revenue"), None), "urgent_rate": (share("urgent", "orders"), F.col("orders"))})
        .unionByName(M.extract(li, "shipping", "day", ["line", "flag"], {"units": (F.col("units"), None), "discount_rate": (share("cut", "lines"), F.col("lines"))}))
        .unionByName(M.extract(e, "funnel", "day", [], {"click_rate": (share("clicks", "views"), F.col("views")), "purchase_rate": (share("purchases", "clicks"), F.col("clicks")), "volume": (F.col("n"), None)}))
    )


@query(f"WITH {_METRICS_SQL} SELECT * FROM long")
def an_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


def _series(df):
    return df.withColumn("series", F.concat_ws("|", "dataset", "metric", "dimensions")).withColumn("sample", F.coalesce("sample", F.lit(1 << 30)))


@query(f"WITH {_chain_sql().replace(_SQL, _METRICS_SQL + ', points AS (SELECT concat_ws(' + repr('|') + ', dataset, metric, dimensions) AS series, day, value, coalesce(sample, 1073741824) AS n FROM long)')} SELECT series, day, strategy, round(expected, 3) AS expected, CASE WHEN expected IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN abs(value - expected) >= near_ THEN 'ANOMALY' ELSE 'NORMAL' END AS status FROM g")
def an_metric_chain(spark, sf_dir):
    """The chain's verdict on the last point of every extracted series."""
    c = A.chain(_series(metrics(spark, sf_dir)), sample="sample", least_sample=1)
    return c.select("series", "day", "strategy", F.round("expected", 3).alias("expected"), "status")
