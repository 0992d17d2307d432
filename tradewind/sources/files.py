"""File sources: exact-header CSV, JSON arrays and lines, finite reads of streaming sinks, incremental boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must be the schema's columns in order, a byte order mark aside; values that don't parse raise."""
    head = spark.read.option("header", "false").csv(path).first()
    found = [] if head is None else [(x or "").lstrip("﻿").strip() for x in head]
    if found != schema.names:
        raise ValueError(f"{path}: the header is {found}, expected {schema.names}")
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "FAILFAST").csv(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def data_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All data files below a folder that a stream wrote, whatever its log says; partition columns stay."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    it, found = fs.listFiles(root, True), []
    while it.hasNext():
        p = it.next().getPath()
        if p.getName().endswith(".parquet") and not p.getName().startswith(("_", ".")) and "_spark_metadata" not in p.toString():
            found.append(p.toString())
    if not found:
        raise FileNotFoundError(f"no Parquet files below {path}")
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*sorted(found))


def since(watermark: str, lookback_days: int, c: str) -> Column:
    """Rows from lookback_days before the last watermark on, inclusive: late changes come again."""
    return F.col(c) >= F.expr(f"timestamp '{watermark}' - interval {int(lookback_days)} days")
