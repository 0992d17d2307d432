"""Explainable baselines on metric series: trailing medians, weekday medians, robust trends, scores, walk-forward tests.

A series' history is bounded by WINDOW points, so a frame is a small array on each row; series
are the unit of parallel work and no more than their window is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, LEAST, LEAST_WEEKDAY = 28, 7, 4
#: Scale of the modified z score (the normal distribution's third quartile).
Z = 0.67448975


def middle(a: Column) -> Column:
    """Median of an array; null if empty."""
    s, n = F.array_sort(a), F.size(a)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def with_history(points: DataFrame, key: str = "series", time: str = "day", value: str = "value") -> DataFrame:
    """Each point with the values before it: the last WINDOW (history), and those of its weekday (weekday_history)."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-WINDOW, -1)
    d = Window.partitionBy(key, F.weekday(time)).orderBy(time).rowsBetween(-(WINDOW // 7 + 4), -1)
    return points.withColumn("history", F.collect_list(value).over(w)).withColumn("weekday_history", F.collect_list(value).over(d))


def robust(points: DataFrame, value: str = "value") -> DataFrame:
    """baseline, strategy, fallback_used, mad, score: the weekday's median if there are enough points, else the trailing median."""
    weekday, trail = F.size("weekday_history") >= LEAST_WEEKDAY, F.size("history") >= LEAST
    x = points.withColumn("strategy", F.when(weekday, "day_of_week").when(trail, "robust_history"))
    x = x.withColumn("used", F.when(weekday, F.col("weekday_history")).when(trail, F.col("history"))).withColumn("fallback_used", ~weekday & trail)
    x = x.withColumn("baseline", middle(F.col("used")))
    x = x.withColumn("mad", middle(F.transform("used", lambda v: F.abs(v - F.col("baseline")))))
    gap = F.col(value) - F.col("baseline")
    score = F.when(F.col("mad") > 1e-12, F.abs(Z * gap / F.nullif(F.col("mad"), F.lit(0.0)))).when(F.col("baseline") != 0, F.abs(gap / F.nullif(F.col("baseline"), F.lit(0.0)))).otherwise(F.abs(gap))
    return x.withColumn("score", score)


def graded(points: DataFrame, warn: float = 3.5, critical: float = 6.0) -> DataFrame:
    """status: INSUFFICIENT_HISTORY, NORMAL, WARNING or CRITICAL; confidence by the number of references."""
    status = F.when(F.col("baseline").isNull(), "INSUFFICIENT_HISTORY").when(F.col("score") >= critical, "CRITICAL").when(F.col("score") >= warn, "WARNING").otherwise("NORMAL")
    n = F.size("used")
    sure = F.when(F.col("baseline").isNull(), None).when(~F.col("fallback_used") & (n >= 8), "HIGH").when(n >= 2 * LEAST, "MEDIUM").otherwise("LOW")
    return points.withColumn("status", status).withColumn("confidence", sure)


def trend(points: DataFrame, key: str = "series", time: str = "day", value: str = "value") -> DataFrame:
    """(key, time, value, slope, prediction) of each series' last point: median of pairwise slopes over the last WINDOW points before it, per day."""
    w = Window.partitionBy(key).orderBy(time)
    hist = F.collect_list(F.struct(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")).cast("double").alias("x"), F.col(value).alias("y"))).over(w.rowsBetween(-WINDOW, -1))
    last = points.withColumn("h", hist).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).filter("n = 1").drop("n").filter(F.size("h") >= LEAST)
    slopes = F.expr("filter(flatten(transform(h, (a, i) -> transform(slice(h, i + 2, size(h)), b -> (b.y - a.y) / nullif(b.x - a.x, 0)))), s -> s is not null)")
    last = last.withColumn("slope", middle(slopes))
    level = middle(F.transform("h", lambda p: p["y"] - F.col("slope") * p["x"]))
    now = F.datediff(F.col(time), F.lit("1970-01-01").cast("date")).cast("double")
    return last.select(key, time, value, "slope", (level + F.col("slope") * now).alias("prediction"))

#: Points that a chain of baselines looks back on, and how many each needs; a chain's order.
LONGEST, LEAST_TREND, LEAST_SEASONAL = 56, 14, 28
CHAIN = ("seasonal_trend", "trend", "day_of_week", "robust_history")
#: Inclusive bounds of the modified z score, the ratio to the baseline, and the plain deviation.
WARNING, CRITICAL = (3.5, 0.5, 1.0), (6.0, 1.0, 5.0)


_TREND_SLOPES = "filter(flatten(transform(h, (a, i) -> transform(slice(h, i + 2, size(h)), b -> (b.y - a.y) / nullif(b.x - a.x, 0)))), s -> s is not null)"


def _stamp(c: Column | str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")


def _back(time: str, value: str) -> Column:
    return F.struct(F.col(time).alias("day"), _stamp(F.col(time)).alias("x"), F.weekday(time).alias("w"), F.col(value).alias("y"))


def _enough(sample: str | None, least_sample: int) -> Column:
    return F.lit(True) if sample is None else F.coalesce(F.col(sample) >= least_sample, F.lit(False))


def chain(points: DataFrame, order: tuple[str, ...] = CHAIN, key: str = "series", time: str = "day", value: str = "value", sample: str | None = None, least_sample: int = 0) -> DataFrame:
    """Each series' last point against the first baseline of order that has enough points before it.

    (key, time, value, strategy, fallback_used, expected, slope, references, mad, lower, upper,
    status, severity, explanation). Trends are medians of pairwise slopes over LONGEST points, in
    days; a seasonal one takes its level from the points of the same weekday. Points whose sample is
    smaller than least_sample are left out, and a last point with one has INSUFFICIENT_HISTORY,
    as has one without a baseline. Points without a value are left out; of equal times any is last.
    """
    enough = _enough(sample, least_sample)
    w = Window.partitionBy(key).orderBy(F.desc(time))
    x = points.filter(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(w)).withColumn("__enough", enough)
    now = x.filter("__n = 1").select(key, time, value, F.col("__enough").alias("enough"))
    # ranked and cut before anything is gathered: a series sends its last LONGEST points at most
    last = x.filter("__n > 1 and __enough").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= LONGEST)
    h = last.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(_back(time, value))).alias("h"))
    met = now.join(h, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    return _judged(met.withColumn("h", F.coalesce("h", F.array().cast(h.schema["h"].dataType))), order, key, time, value)


def walk(points: DataFrame, order: tuple[str, ...] = CHAIN, key: str = "series", time: str = "day", value: str = "value", sample: str | None = None, least_sample: int = 0) -> DataFrame:
    """Every point against what the chain says from the points before it: chain()'s columns, a row for each point.

    The state of a point is its last LONGEST points with a large enough sample, whatever the
    length of the series; of equal times any is first.
    """
    w = Window.partitionBy(key)
    x = points.filter(F.col(value).isNotNull()).withColumn("enough", _enough(sample, least_sample))
    # points are counted, and the frame is one of counts: small samples take no place in it
    x = x.withColumn("__c", F.coalesce(F.sum(F.col("enough").cast("long")).over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("h", F.collect_list(F.when(F.col("enough"), _back(time, value))).over(w.orderBy("__c").rangeBetween(-LONGEST, -1)))
    return _judged(x.select(*points.columns, "enough", "h"), order, key, time, value)


def _judged(g: DataFrame, order: tuple[str, ...], key: str, time: str, value: str) -> DataFrame:
    """Points with enough and their history h (day, x, w, y), oldest first, against the chain's baselines."""
    rest_of = [c for c in g.columns if c not in (key, time, value, "enough", "h")]
    stamp = _stamp
    slopes = F.expr(_TREND_SLOPES)
    g = g.withColumn("slope", middle(slopes)).withColumn("same", F.filter("h", lambda p: p["w"] == F.weekday(time)))
    now, n = stamp(F.col(time)), F.size("h")
    level = lambda of: middle(F.transform(of, lambda p: p["y"] - F.coalesce("slope", F.lit(0.0)) * p["x"]))
    plain = lambda of: middle(F.transform(of, lambda p: p["y"]))
    g = g.withColumns({"tail": F.slice("h", F.greatest(n - WINDOW + 1, F.lit(1)), WINDOW), "seasonal": level("same"), "straight": level("h")})
    flat = lambda of, base: F.transform(of, lambda p: p["y"] - base)
    line = lambda of, base: F.transform(of, lambda p: p["y"] - base - F.col("slope") * p["x"])
    known = F.col("slope").isNotNull()
    each = {
        "seasonal_trend": (known & (n >= LEAST_SEASONAL) & (F.size("same") >= LEAST_WEEKDAY), F.col("seasonal") + F.col("slope") * now, line("same", F.col("seasonal")), F.size("same")),
        "trend": (known & (n >= LEAST_TREND), F.col("straight") + F.col("slope") * now, line("h", F.col("straight")), F.lit(0)),
        "day_of_week": (F.size("same") >= LEAST_WEEKDAY, plain("same"), flat("same", plain("same")), F.size("same")),
        "robust_history": (F.size("tail") >= LEAST, plain("tail"), flat("tail", plain("tail")), F.lit(0)),
    }
    first = F.coalesce(*[F.when(each[s][0], F.struct(F.lit(s).alias("strategy"), F.lit(i > 0).alias("fallback_used"), each[s][1].alias("expected"), each[s][2].alias("rest"), each[s][3].alias("references"))) for i, s in enumerate(order)])
    g = g.withColumn("b", F.when(F.col("enough"), first))
    trended = F.col("b.strategy").isin("seasonal_trend", "trend")
    g = g.select(key, time, value, *rest_of, "b.strategy", "b.fallback_used", "b.expected", F.when(trended, F.col("slope")).alias("slope"), F.coalesce("b.references", F.lit(0)).alias("references"), F.col("b.rest").alias("rest"))
    g = g.withColumn("center", middle(F.col("rest")))
    g = g.withColumn("mad", middle(F.transform("rest", lambda v: F.abs(v - F.col("center")))))
    bound = lambda z: F.when(F.col("mad") > 1e-12, z[0] * F.col("mad") / Z).when(F.col("expected") != 0, F.abs("expected") * z[1]).when(F.col("expected").isNotNull(), z[2])
    gap = F.col(value) - F.col("expected")
    bad, worst = F.abs(gap) >= bound(WARNING), F.abs(gap) >= bound(CRITICAL)
    status = F.when(F.col("expected").isNull(), "INSUFFICIENT_HISTORY").when(bad, "ANOMALY").otherwise("NORMAL")
    severity = F.when(F.col("expected").isNull(), "INFO").when(worst, "CRITICAL").when(bad, "WARNING").otherwise("INFO")
    place = F.when(bad, F.format_string("%.2f%% %s the expected range", F.abs(gap / F.nullif("expected", F.lit(0.0))) * 100, F.when(gap < 0, "below").otherwise("above"))).otherwise("within the expected range")
    label = F.regexp_replace(F.regexp_replace("strategy", "seasonal_trend", "seasonal + trend"), "_", " ")
    said = F.when(F.col("expected").isNull(), "No baseline has enough points before this one.").otherwise(F.concat(F.lit("Current value is "), place, F.format_string(". Expected: %.2f. Observed: %.2f. Baseline: ", "expected", F.col(value)), label, F.lit(".")))
    return g.withColumns({"lower": F.col("expected") - bound(WARNING), "upper": F.col("expected") + bound(WARNING), "status": status, "severity": severity, "explanation": said}).drop("rest", "center")
