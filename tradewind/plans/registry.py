"""Queries and their SQL by name; the plan modules fill both, catalogue imports them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored bytes of a table that one task gets where shares() deals it.
SHARE = 2 << 20


def shares(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts rows of a table (or what follows from them row by row) are dealt: one for each SHARE of its files, spark.sql.shuffle.partitions at least.

    What a task sorts and adds up then stays as it is while the table grows, and doesn't spill.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // SHARE))
