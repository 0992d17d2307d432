"""Metric series from fact tables: one pass a table to long rows with a sample size each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_dimensions(dimensions: Sequence[str]) -> Column:
    """The dimensions of a row as JSON with sorted keys; null ones are left out."""
    return F.to_json(F.struct(*[F.col(d).cast("string").alias(d) for d in sorted(dimensions)]))


def extract(df: DataFrame, dataset: str, day: str, dimensions: Sequence[str], metrics: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """(dataset, metric, dimensions, day, value, sample) of aggregated facts, a row for each metric that has a value.

    metrics: {name: (value, what it is a share or mean of)}; a metric without a sample has null
    there. df is read once, whatever the number of metrics. A series is (dataset, metric,
    dimensions); rows that share one and a day are the caller's fault and stay.
    """
    long = lambda c: F.lit(None).cast("long") if c is None else c.cast("long")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), long(n).alias("sample")) for m, (v, n) in metrics.items()])
    x = df.select(F.lit(dataset).alias("dataset"), canonical_dimensions(dimensions).alias("dimensions"), F.col(day).alias("day"), F.inline(each))
    return x.filter("value is not null and day is not null").select("dataset", "metric", "dimensions", "day", "value", "sample")
