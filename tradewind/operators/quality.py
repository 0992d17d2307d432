"""Data-quality rules, all of a table's but uniqueness in one pass of one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.relational import duplicate_excess


@dataclass(frozen=True)
class Rule:
    """name; violations: a condition for bad rows; or a kind that looks at the whole table."""

    name: str
    severity: str = "CRITICAL"
    violation: Column | None = None
    columns: Sequence[str] = field(default_factory=tuple)
    most: float = 0.0  # share of bad rows that still passes
    least_rows: int | None = None
    reference: int | None = None  # rows of the run before
    newest: str | None = None  # column of instants, with max_age seconds before now
    max_age: float = 0.0
    now: str | None = None


def not_null(c: str, most: float = 0.0, severity: str = "CRITICAL") -> Rule:
    return Rule(f"not_null:{c}", severity, F.col(c).isNull(), (c,), most)


def unique(*cols: str, most: float = 0.0, severity: str = "CRITICAL") -> Rule:
    return Rule(f"unique:{','.join(cols)}", severity, None, cols, most)


def allowed(c: str, values: Sequence, null_ok: bool = False, severity: str = "CRITICAL") -> Rule:
    bad = ~F.col(c).isin(*values)
    return Rule(f"allowed:{c}", severity, F.coalesce(bad, F.lit(not null_ok)), (c,))


def bounds(c: str, low: float | None = None, high: float | None = None, strict: bool = False, null_ok: bool = True, severity: str = "CRITICAL") -> Rule:
    x = F.col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    if low is not None:
        bad = bad | ((x <= low) if strict else (x < low))
    if high is not None:
        bad = bad | (x > high)
    return Rule(f"bounds:{c}", severity, F.coalesce(bad, F.lit(not null_ok)), (c,))


def ordered(a: str, b: str, null_ok: bool = True, severity: str = "CRITICAL") -> Rule:
    return Rule(f"ordered:{a}<={b}", severity, F.coalesce(F.col(a) > F.col(b), F.lit(not null_ok)), (a, b))


def pattern(c: str, regex: str, null_ok: bool = False, severity: str = "CRITICAL") -> Rule:
    return Rule(f"pattern:{c}", severity, F.coalesce(~F.col(c).rlike(regex), F.lit(not null_ok)), (c,))


def row_count(least: int, severity: str = "CRITICAL") -> Rule:
    return Rule("row_count", severity, least_rows=least)


def volume(reference: int | None, most: float, severity: str = "WARNING") -> Rule:
    return Rule("volume_change", severity, reference=-1 if reference is None else reference, most=most)


def fresh(c: str, now: str, max_age: float, severity: str = "WARNING") -> Rule:
    return Rule(f"freshness:{c}", severity, columns=(c,), newest=c, max_age=max_age, now=now)


RESULT = "rule string, severity string, observed double, threshold double, status string"


def run(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, severity, observed, threshold, status), a row a rule; the checks themselves are one aggregate.

    A rule on a column that isn't there fails instead of raising. Without rows a share has no
    evidence: WARN. A violated critical rule is FAIL, any other WARN.
    """
    if df.isStreaming:
        raise ValueError("quality rules need a finite table")
    lacking = {r.name for r in rules if any(c not in df.columns for c in r.columns)}
    used = [r for r in rules if r.name not in lacking]
    plain = [r for r in used if not r.name.startswith("unique:")]
    measures = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(plain):
        if r.violation is not None:
            measures.append(F.count_if(r.violation).cast("double").alias(f"m{i}"))
        elif r.newest:
            measures.append((F.unix_timestamp(F.lit(r.now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(r.newest).cast("timestamp")))).cast("double").alias(f"m{i}"))
    base = df.agg(*measures)
    for i, r in enumerate([r for r in used if r.name.startswith("unique:")]):
        base = base.crossJoin(duplicate_excess(df, list(r.columns)).select(F.col("excess").cast("double").alias(f"u{i}")))  # one row and one row
    n = F.col("n").cast("double")
    made, u = [], 0
    for r in rules:
        bad = F.lit("FAIL" if r.severity == "CRITICAL" else "WARN")
        if r.name in lacking:
            observed, threshold, status = F.lit(None).cast("double"), F.lit(None).cast("double"), bad
        elif r.least_rows is not None:
            observed, threshold = n, F.lit(float(r.least_rows))
            status = F.when(observed < threshold, bad).otherwise("PASS")
        elif r.reference is not None:
            ref = F.lit(float(r.reference))
            observed, threshold = F.when(ref == 0, F.when(n == 0, 0.0)).when(ref > 0, F.abs(n - ref) / F.greatest(ref, F.lit(1.0))), F.lit(r.most)
            status = F.when(ref < 0, "WARN").when(F.coalesce(observed <= threshold, F.lit(False)), "PASS").otherwise(bad)
        elif r.newest:
            observed, threshold = F.col(f"m{plain.index(r)}"), F.lit(r.max_age)
            status = F.when(F.coalesce(observed.between(0, r.max_age), F.lit(False)), "PASS").otherwise(bad)
        else:
            if r.name.startswith("unique:"):
                count, u = F.col(f"u{u}"), u + 1
            else:
                count = F.col(f"m{plain.index(r)}")
            observed, threshold = F.try_divide(count, n), F.lit(r.most)
            status = F.when(n == 0, "WARN").when(observed <= threshold, "PASS").otherwise(bad)
        made.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), observed.alias("observed"), threshold.cast("double").alias("threshold"), status.alias("status")))
    return base.select(F.inline(F.array(*made)))


def summary(results: DataFrame) -> DataFrame:
    """One row: FAIL over WARN over PASS, and whether the run blocks what follows."""
    fail, warn = F.bool_or(F.col("status") == "FAIL"), F.bool_or(F.col("status") == "WARN")
    return results.agg(F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS").alias("status"), F.coalesce(fail, F.lit(False)).alias("blocking"), F.count(F.lit(1)).alias("rules"))


def registry(df: DataFrame, identity: str, checks: dict[str, tuple[str, str, Column]], samples: int = 10) -> DataFrame:
    """(code, severity, classification, count, sample_ids): every code of checks, found or not, with its first ids.

    checks: {code: (severity, classification, condition)}, all in one pass. A sample is the least
    ids of a code; ranks are limited before the shuffle, so no code is gathered. Null conditions
    don't hold; a null id counts but is no sample; an id that repeats is a sample as often.
    """
    found = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, (_, _, cond) in checks.items()]))
    rows = df.select(F.col(identity).cast("string").alias("id"), F.explode(found).alias("code"))
    counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("code").orderBy("id")
    first = rows.filter("id is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= samples)
    named = first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    known = df.sparkSession.createDataFrame([(code, severity, kind) for code, (severity, kind, _) in checks.items()], "code string, severity string, classification string")
    out = known.join(counts, "code", "left").join(named, "code", "left")
    return out.select("code", "severity", "classification", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"))
