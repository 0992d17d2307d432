"""Sinks: guarded snapshot overwrite, tenant replace, validated swap, idempotent upsert, JSON lines."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def overwrite(df: DataFrame, path: str, allowed: Sequence[str], by: Sequence[str] = (), tries: int = 3, pause: float = 1.0) -> None:
    """Replace a snapshot; only below the allowed roots, and never a root itself."""
    clean = path.rstrip("/")
    if ".." in clean.split("/") or not any(clean.startswith(a.rstrip("/") + "/") for a in allowed):
        raise ValueError(f"{path} isn't below any of {list(allowed)}")
    for n in range(tries):
        try:
            w = df.write.mode("overwrite")
            (w.partitionBy(*by) if by else w).parquet(clean)
            return
        except (OSError, Py4JJavaError, PySparkException) as e:
            # a wrong plan or path stays wrong; what failed while writing may pass
            if n == tries - 1 or isinstance(e, (AnalysisException, IllegalArgumentException)):
                raise
            time.sleep(pause * 2**n)


def replace_tenants(df: DataFrame, path: str, tenant: str = "business_id") -> None:
    """Replace the tenants that df has; the others' partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def swap(df: DataFrame, path: str, valid: Callable[[DataFrame], bool]) -> None:
    """Write beside the table, check what was written, then put it in its place.

    A failed check, and a rename that the file system refuses, leave the table as it was. Between
    the two renames readers find no table: directories can't be exchanged at once.
    """
    spark = df.sparkSession
    staged, old = f"{path.rstrip('/')}__staged", f"{path.rstrip('/')}__old"
    df.write.mode("overwrite").parquet(staged)
    fs, target = _fs(spark, path)
    new, gone = _fs(spark, staged)[1], _fs(spark, old)[1]
    if not valid(spark.read.schema(df.schema).parquet(staged)):
        fs.delete(new, True)
        raise ValueError(f"what was written for {path} isn't valid")
    fs.delete(gone, True)
    there = fs.exists(target)
    if there and not fs.rename(target, gone):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, target):
        if there:
            fs.rename(gone, target)
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(gone, True)


def upsert(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rows of df in place of those with the same keys: anti join, union, swap. Null keys match null keys; replays change nothing."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        old = spark.read.schema(df.schema).parquet(path)
        own = df.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
        df = old.join(own, cond, "left_anti").select(*df.columns).unionByName(df)
    swap(df, path, lambda _: True)


def json_lines(df: DataFrame, path: str) -> None:
    """Compact JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
